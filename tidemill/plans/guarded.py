"""Read-only SQL under a guard, single or chained.

Spark parses and analyses the text; nothing here does. A statement counts as a query if it is valid
in place of a subquery, which no command, write or second statement is. What the analysed plan
reads is then compared with the databases the session may see.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from py4j import java_gateway
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.sanity import result_sanity
from tidemill.plans.results import ResultStore
from tidemill.session import child_session

ROW_CAP = 1000
TIMEOUT_S = 60
MAX_HOPS = 5

# Kinds of refusal.
NON_READ_ONLY = "non_read_only"
DRY_RUN_NOT_PASSED = "dry_run_not_passed"
EXECUTION_ERROR = "execution_error"

TOO_MANY_STEPS = "too_many_steps"

# Functions that run code or tell file names. Some would already run during analysis, so they are
# looked for in the parsed statement.
DENIED_FUNCTIONS = frozenset({
    "input_file_block_length", "input_file_block_start", "input_file_name", "java_method", "reflect", "try_reflect",
})

# Plan leaves that read nothing outside the plan itself.
_INLINE_LEAVES = frozenset({"CTERelationRef", "LocalRelation", "OneRowRelation", "Range", "UnionLoopRef"})
_DENIED_NODES = frozenset({"ScriptTransformation"})

# The thread's properties a job group is made of.
_GROUP_PROPERTIES = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")


@dataclass(frozen=True)
class Refusal:
    """Why a statement did not run; ``suggestions`` are the columns Spark thinks were meant."""

    kind: str
    message: str
    detail: str | None = None
    suggestions: tuple[str, ...] = ()


@dataclass(frozen=True)
class Provenance:
    sql: str
    elapsed_ms: int
    row_count: int
    truncated: bool


@dataclass
class Planned:
    frame: DataFrame | None = None
    refusal: Refusal | None = None


@dataclass
class Outcome:
    """``frame`` is the whole result, ``rows`` at most the cap."""

    frame: DataFrame | None = None
    rows: list[Row] = field(default_factory=list)
    provenance: Provenance | None = None
    refusal: Refusal | None = None
    warnings: list[Row] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        return self.refusal is None


@dataclass
class Chain:
    """Outcomes of the hops that ran; ``display`` is the number of the hop to show."""

    hops: list[Outcome]
    display: int | None
    outcome: str

    @property
    def frame(self) -> DataFrame | None:
        return self.hops[self.display - 1].frame if self.display else None


def _subplans(plan):
    for group in (plan.children(), plan.subqueries(), plan.innerChildren()):
        for i in range(group.size()):
            yield group.apply(i)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


class _Lineage:
    """Which columns further down in a plan the columns used above are made of, by expression id."""

    def __init__(self, made: dict[int, frozenset[int]] | None = None):
        self.made = made or {}

    def below(self, expression_id: int) -> frozenset[int]:
        return self.made.get(expression_id, frozenset([expression_id]))

    def through(self, named: list[tuple[int, frozenset[int]]]) -> _Lineage:
        """One projection further down: outputs and the columns each is made of."""
        own = dict(named)
        step = lambda ids: frozenset(y for x in ids for y in own.get(x, (x,)))
        return _Lineage({**own, **{k: step(v) for k, v in self.made.items()}})


# Nodes that hand all rows of their child on, each once.
_ROW_KEEPING = frozenset({"Filter", "SubqueryAlias", "View", "Sort", "Window", "RepartitionByExpression", "Repartition", "ResolvedHint", "GlobalLimit", "LocalLimit"})
_REPEATING_JOINS = frozenset({"INNER", "CROSS", "LEFT OUTER", "RIGHT OUTER", "FULL OUTER"})


def _ids(expression) -> frozenset[int]:
    return frozenset(a.exprId().id() for a in _items(expression.references().toSeq()))


def _joins_below(plan, lineage: _Lineage) -> list[tuple]:
    """(join, lineage) of joins whose rows reach ``plan`` as they are: through renames, filters, projections, sorts,
    windows, unions and other joins."""
    kind = plan.getClass().getSimpleName()
    if kind == "Join":
        inner = [j for side in (plan.left(), plan.right()) for j in _joins_below(side, lineage)]
        return [(plan, lineage), *inner] if plan.joinType().sql() in _REPEATING_JOINS else inner
    if kind == "Project":
        made = [(e.exprId().id(), _ids(e)) for e in _items(plan.projectList()) if e.getClass().getSimpleName() == "Alias"]
        return _joins_below(plan.child(), lineage.through(made))
    if kind == "Union":
        return [j for side in _items(plan.children()) for j in _joins_below(side, lineage.through(_same_places(plan, side)))]
    if kind in _ROW_KEEPING:
        return _joins_below(plan.child(), lineage)
    return []


def _same_places(outer, inner) -> list[tuple[int, frozenset[int]]]:
    return [(a.exprId().id(), frozenset([b.exprId().id()])) for a, b in zip(_items(outer.output()), _items(inner.output()))]


def _equal_keys(join) -> list[tuple[int, int]]:
    """Pairs (column of the left side, column of the right side) that the join holds equal."""
    left, right = ({a.exprId().id() for a in _items(side.output())} for side in (join.left(), join.right()))
    waiting = [join.condition().get()] if join.condition().isDefined() else []
    pairs = []
    while waiting:
        e = waiting.pop()
        kind = e.getClass().getSimpleName()
        if kind == "And":
            waiting += [e.left(), e.right()]
        elif kind in ("EqualTo", "EqualNullSafe"):
            sides = [[a.exprId().id() for a in _items(x.references().toSeq())] for x in (e.left(), e.right())]
            if all(len(s) == 1 for s in sides):
                a, b = sides[0][0], sides[1][0]
                if a in right and b in left:
                    a, b = b, a
                if a in left and b in right:
                    pairs.append((a, b))
    return pairs


def _summed_from(aggregate, side, lineage: _Lineage) -> list[str]:
    """Outputs of an aggregation that sum, count or average columns of one side alone, or count rows."""
    own = {a.exprId().id() for a in _items(side.output())}
    names = []
    for output in _items(aggregate.aggregateExpressions()):
        waiting = [output]
        while waiting:
            e = waiting.pop()
            if e.getClass().getSimpleName() == "AggregateExpression":
                used = {x for i in _ids(e) for x in lineage.below(i)}
                if not e.isDistinct() and e.aggregateFunction().prettyName() in ("sum", "count", "avg", "mean") and used <= own:
                    names.append(output.name())
                continue
            waiting += _items(e.children())
    return names


class GuardedSession:
    """Queries over the tables of ``databases`` and over earlier results, nothing else."""

    def __init__(
        self, spark: SparkSession, databases: Sequence[str], row_cap: int = ROW_CAP, timeout_s: float = TIMEOUT_S
    ):
        self.spark = child_session(spark)
        # A path is not a table name here.
        self.spark.conf.set("spark.sql.runSQLOnFiles", "false")
        self.databases = frozenset(d.lower() for d in databases)
        self.row_cap = row_cap
        self.timeout_s = timeout_s
        self.turns = 0
        self.results = ResultStore(self.spark)

    def plan(self, sql: str) -> Planned:
        """Check and analyse; runs no query."""
        body = sql.strip().rstrip(";").rstrip()
        if not body:
            return Planned(refusal=Refusal(NON_READ_ONLY, "empty statement"))
        try:
            denied = self._denied(f"SELECT * FROM (\n{body}\n) guarded")
            if denied:
                return Planned(refusal=Refusal(NON_READ_ONLY, f"{denied} is not permitted"))
            # The line break keeps a trailing comment from hiding the parenthesis. Text that closes
            # the parenthesis itself cannot fit both forms.
            self.spark.sql(f"WITH guarded AS (\n{body}\n) SELECT * FROM guarded")
            frame = self.spark.sql(f"SELECT * FROM (\n{body}\n) guarded")
        except ParseException as e:
            return Planned(refusal=Refusal(NON_READ_ONLY, "not a single read-only query", e.getCondition()))
        except AnalysisException as e:
            kind = NON_READ_ONLY if self._names_outside(e) else DRY_RUN_NOT_PASSED
            proposal = (e.getMessageParameters() or {}).get("proposal", "")
            names = tuple(".".join(re.findall(r"`((?:[^`]|``)+)`", part)) for part in proposal.split(", ") if part)
            return Planned(refusal=Refusal(kind, e.getCondition() or "analysis failed", str(e), names))
        reason = self._outside(frame._jdf.queryExecution().analyzed())
        if reason:
            return Planned(refusal=Refusal(NON_READ_ONLY, reason))
        return Planned(frame=frame)

    def _denied(self, sql: str) -> str | None:
        """A function of the parsed statement that may not be called, or a name that is put together."""
        gateway = self.spark.sparkContext._gateway
        is_instance = lambda node, name: java_gateway.is_instance_of(gateway, node, name)
        waiting = [self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)]
        while waiting:
            node = waiting.pop()
            kind = node.getClass().getSimpleName()
            if "UnresolvedIdentifier" in kind:
                return "IDENTIFIER"
            if kind in ("UnresolvedFunction", "UnresolvedTableValuedFunction"):
                parts = node.nameParts() if kind == "UnresolvedFunction" else node.name()
                name = parts.last().lower()
                if name in DENIED_FUNCTIONS:
                    return name
            groups = [node.children()]
            if is_instance(node, "org.apache.spark.sql.catalyst.plans.logical.LogicalPlan"):
                groups += [node.expressions(), node.innerChildren()]
            elif is_instance(node, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
                waiting.append(node.plan())
            waiting += [group.apply(i) for group in groups for i in range(group.size())]
        return None

    def _names_outside(self, error: AnalysisException) -> bool:
        """Whether the relation Spark could not find is qualified with something else than a database
        of the session: a file format and a path, for instance."""
        if error.getCondition() != "TABLE_OR_VIEW_NOT_FOUND":
            return False
        parts = re.findall(r"`((?:[^`]|``)+)`", (error.getMessageParameters() or {}).get("relationName", ""))
        return len(parts) > 1 and parts[-2].lower() not in self.databases

    def _outside(self, plan) -> str | None:
        """Why the analysed plan reads more than it may, if it does."""
        name = plan.getClass().getSimpleName()
        if name in _DENIED_NODES:
            return f"{name} is not permitted"
        if name == "View" and not plan.isTempView():
            # A catalog view was defined by its owner; only where it lives matters.
            return self._not_allowed(plan.desc().identifier())
        if name == "LogicalRelation":
            table = plan.catalogTable()
            if table.isDefined():
                return self._not_allowed(table.get().identifier())
            location = getattr(plan.relation(), "location", None)
            own = location is not None and all(self.results.holds(p.toString()) for p in _items(location().rootPaths()))
            # What an earlier query of this session has written may be read again.
            return None if own else "a file is not a relation"
        if name == "HiveTableRelation":
            return self._not_allowed(plan.tableMeta().identifier())
        below = list(_subplans(plan))
        if not plan.children().size() and name not in _INLINE_LEAVES and not below:
            return f"{name} is not a relation of the session"
        for child in below:
            reason = self._outside(child)
            if reason:
                return reason
        return None

    def _not_allowed(self, identifier) -> str | None:
        db = identifier.database()
        if db.isDefined() and db.get().lower() in self.databases:
            return None
        return f"{identifier.unquotedString()} is outside {sorted(self.databases)}"

    def run(self, sql: str) -> Outcome:
        """Run a query, once: its whole result is written, and rows and warnings are read from there. At most the row
        cap reaches the driver."""
        planned = self.plan(sql)
        if planned.refusal is not None:
            return Outcome(refusal=planned.refusal)
        started = time.monotonic()
        try:
            stored = self._within_time(lambda: self.results.write(planned.frame))
            # One row more than the cap tells whether the result was cut.
            rows = self._collect(stored.first(self.row_cap + 1))
            # All rows are judged, not only those shown.
            warnings = self._collect(result_sanity(stored.frame_of(stored.rows))) + self._fanouts(planned.frame)
        except Exception as e:  # Spark errors, and the JVM error of a job the timer cancelled
            return Outcome(refusal=Refusal(EXECUTION_ERROR, "execution failed", str(e)))
        truncated = len(rows) > self.row_cap
        rows = rows[: self.row_cap]
        provenance = Provenance(sql, int((time.monotonic() - started) * 1000), len(rows), truncated)
        return Outcome(stored.frame, rows, provenance, warnings=warnings)

    def close(self) -> None:
        """Delete the results; frames and views that read them may not be used any more."""
        self.results.clear()

    def _fanouts(self, frame: DataFrame) -> list[Row]:
        """A warning for every sum, count or average of one side's values that a join has repeated before.

        The analysed plan tells which joins stand below an aggregation and on which columns; how often the
        other side holds a key is measured on the data, and of a join without a condition, how many rows the other
        side has. An aggregation between join and sum ends the search. Joins on a range alone are not measured.
        """
        found = {}
        # Common tables stand where they are named, so that any part of the plan can be counted by itself.
        inline = self.spark._jvm.org.apache.spark.sql.catalyst.optimizer.InlineCTE(True, False)
        waiting = [inline.apply(frame._jdf.queryExecution().analyzed())]
        while waiting:
            node = waiting.pop()
            waiting += list(_subplans(node))
            if node.getClass().getSimpleName() == "Aggregate":
                for join, lineage in _joins_below(node.child(), _Lineage()):
                    for column, most in self._repeated(node, join, lineage):
                        found[column] = max(most, found.get(column, 0))
        return [Row(kind="join_fanout", column_name=c, low=None, high=float(n)) for c, n in sorted(found.items())]

    def _repeated(self, aggregate, join, lineage: _Lineage) -> list[tuple[str, int]]:
        """(column, most rows of one key) for the aggregates over a side whose rows ``join`` repeats."""
        out = []
        keys = _equal_keys(join)
        if not keys and join.condition().isDefined():
            return out
        for mine, other, at in ((join.left(), join.right(), 1), (join.right(), join.left(), 0)):
            columns = _summed_from(aggregate, mine, lineage)
            if not columns:
                continue
            if keys:
                theirs = self._columns(other, [pair[at] for pair in keys])
                # Keys that meet nothing repeat nothing.
                met = theirs.join(self._columns(mine, [pair[1 - at] for pair in keys]).distinct(), theirs.columns, "left_semi")
                counts = met.groupBy(*theirs.columns).agg(F.count(F.lit(1)).alias("n"))
                most = self._collect(counts.agg(F.max("n")))[0][0] or 0
            else:
                most = self._collect(self._columns(other, []).agg(F.count(F.lit(1))))[0][0]
            if most > 1:
                out += [(c, most) for c in columns]
        return out

    def _columns(self, plan, ids: Sequence[int]) -> DataFrame:
        """Columns of an analysed plan by expression id, named by position, without rows that lack one."""
        place = {a.exprId().id(): i for i, a in enumerate(_items(plan.output()))}
        rows = DataFrame(self.spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, plan), self.spark)
        rows = rows.toDF(*[f"c{i}" for i in range(len(place))])
        return rows.select(*[F.col(f"c{place[x]}").alias(f"k{i}") for i, x in enumerate(ids)]).dropna() if ids else rows

    def _collect(self, frame: DataFrame) -> list[Row]:
        return self._within_time(frame.collect)

    def _within_time(self, step: Callable[[], Any]) -> Any:
        context = self.spark.sparkContext
        group = f"guarded-{uuid.uuid4().hex}"
        before = {k: context.getLocalProperty(k) for k in _GROUP_PROPERTIES}
        context.setJobGroup(group, "guarded query", interruptOnCancel=True)
        timer = threading.Timer(self.timeout_s, context.cancelJobGroup, [group])
        timer.start()
        try:
            return step()
        finally:
            timer.cancel()
            for key, value in before.items():
                context.setLocalProperty(key, value)

    def chain(self, steps: Sequence[str], display: int | None = None, max_hops: int = MAX_HOPS) -> Chain:
        """Run queries in order; each may read ``hop_N_result`` of those before it.

        A hop's result is a view on what its query wrote, so later hops compute none of it again and see all of
        it, not the capped rows. The chain stops at the first refusal or failure. One of more than
        ``max_hops`` steps is refused as a whole.
        """
        if len(steps) > max_hops:
            refusal = Refusal(TOO_MANY_STEPS, f"{len(steps)} steps, at most {max_hops}")
            return Chain([Outcome(refusal=refusal)], None, "refused")
        hops: list[Outcome] = []
        for number, sql in enumerate(steps, start=1):
            outcome = self.run(sql)
            hops.append(outcome)
            if not outcome.ok:
                break
            if outcome.rows:
                outcome.frame.createOrReplaceTempView(f"hop_{number}_result")
        # The frames keep their files; the names belong to this chain only.
        for number in range(1, len(hops) + 1):
            self.spark.catalog.dropTempView(f"hop_{number}_result")
        done = [i for i, h in enumerate(hops, start=1) if h.ok]
        if display not in done:
            display = done[-1] if done else None
        return Chain(hops, display, _overall(hops))

    def turn(self, steps: Sequence[str], display: int | None = None) -> Chain:
        """A chain whose shown result stays readable as ``turn_N_result`` in later turns."""
        self.turns += 1
        chain = self.chain(steps, display)
        shown = chain.hops[chain.display - 1] if chain.display else None
        if shown is not None and shown.rows:
            shown.frame.createOrReplaceTempView(f"turn_{self.turns}_result")
        return chain


def _overall(hops: Sequence[Outcome]) -> str:
    kinds = {h.refusal.kind for h in hops if h.refusal is not None}
    if kinds & {NON_READ_ONLY, EXECUTION_ERROR, TOO_MANY_STEPS}:
        return "refused"
    if kinds or not hops:
        return "failed"
    return "flagged" if any(h.warnings for h in hops) else "clean"

"""Declared data checks: counts of failures in one lazy report, and the offending rows.

Failures are what a test query would return: NULL rows for not_null, repeated values for unique,
distinct bad values for accepted_values, orphan rows for relationship, all rows for singular.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.columns import col
from tidemill.operators.joins import orphan_keys, orphan_rows
from tidemill.session import local_frame

REPORT_SCHEMA = "name string, kind string, status string, failures long, message string"


@dataclass(frozen=True)
class Check:
    """One check. ``frame`` is the query of a singular check; ``to`` names a relationship's parent."""

    kind: str
    table: str = ""
    column: str = ""
    values: Sequence = ()
    to: str = ""
    to_column: str = ""
    label: str = ""
    frame: DataFrame | None = field(default=None, compare=False)

    @property
    def name(self) -> str:
        if self.label:
            return self.label
        parts = (self.kind, self.table, self.column, self.to, self.to_column, *map(str, self.values))
        return "_".join(p for p in parts if p)


def not_null(table: str, column: str) -> Check:
    return Check("not_null", table, column)


def unique(table: str, column: str) -> Check:
    return Check("unique", table, column)


def accepted_values(table: str, column: str, values: Sequence) -> Check:
    return Check("accepted_values", table, column, tuple(values))


def relationship(table: str, column: str, to: str, to_column: str) -> Check:
    return Check("relationship", table, column, to=to, to_column=to_column)


def singular(label: str, frame: DataFrame) -> Check:
    return Check("singular", label=label, frame=frame)


def failing_rows(
    check: Check, tables: Mapping[str, DataFrame], limit: int | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """What a failing check complains about; ``limit`` keeps a few examples, the first by ``order`` if given."""
    if check.kind == "singular":
        out = check.frame
    elif check.kind == "not_null":
        out = tables[check.table].where(col(check.column).isNull())
    elif check.kind == "unique":
        out = _value_counts(check, tables).where(F.col("value").isNotNull() & (F.col("n_rows") > 1))
    elif check.kind == "accepted_values":
        # NULL is no value: neither accepted by being listed nor a failure in the data.
        accepted = [v for v in check.values if v is not None]
        out = _value_counts(check, tables).where(F.col("value").isNotNull() & ~F.col("value").isin(accepted))
    elif check.kind == "relationship":
        out = orphan_rows(tables[check.table], check.column, tables[check.to], check.to_column)
    else:
        raise ValueError(f"unknown kind of check {check.kind!r}")
    out = out.orderBy(*[F.asc_nulls_last(c) for c in order]) if order else out
    return out if limit is None else out.limit(limit)


def _value_counts(check: Check, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows per value, combined map-side: a frequent value is one row per task in the shuffle."""
    return tables[check.table].groupBy(col(check.column).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))


def _failures(check: Check, tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row ``(name, kind, failures)``."""
    if check.kind == "relationship":
        orphans = orphan_keys(tables[check.table], check.column, tables[check.to], check.to_column)
        count = orphans.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("failures"))
    else:
        count = failing_rows(check, tables).agg(F.count(F.lit(1)).alias("failures"))
    return count.select(F.lit(check.name).alias("name"), F.lit(check.kind).alias("kind"), "failures")


def _null_failures(checks: Sequence[Check], table: DataFrame) -> DataFrame:
    """All not_null checks of a table from one scan."""
    counts = table.agg(*[F.count_if(col(c.column).isNull()).alias(f"f{i}") for i, c in enumerate(checks)])
    return counts.select(F.inline(F.array(*_named(checks))))


def _value_failures(checks: Sequence[Check], table: DataFrame) -> DataFrame:
    """All unique and accepted_values checks of one column from one aggregation."""
    values = _value_counts(checks[0], {checks[0].table: table}).where(F.col("value").isNotNull())
    bad = {
        "unique": lambda c: F.col("n_rows") > 1,
        "accepted_values": lambda c: ~F.col("value").isin([v for v in c.values if v is not None]),
    }
    counts = values.agg(*[F.count_if(bad[c.kind](c)).alias(f"f{i}") for i, c in enumerate(checks)])
    return counts.select(F.inline(F.array(*_named(checks))))


def _named(checks: Sequence[Check]) -> list[Column]:
    return [
        F.struct(F.lit(c.name).alias("name"), F.lit(c.kind).alias("kind"), F.col(f"f{i}").alias("failures"))
        for i, c in enumerate(checks)
    ]


def run_checks(spark: SparkSession, checks: Sequence[Check], tables: Mapping[str, DataFrame]) -> DataFrame:
    """Report ``(name, kind, status, failures, message)``, one row per check.

    Checks of one table share a scan where they can, and all of them run as one job. A check that cannot be
    analysed (a missing table or column), or fails while it runs, is reported as an error; the others still
    count. Two checks of one name are refused.
    """
    names = [c.name for c in checks]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ValueError(f"several checks are named {repeated}")
    errors, groups = [], {}
    for check in checks:
        try:
            _failures(check, tables)
        except (AnalysisException, KeyError) as e:
            errors.append(_error(check, e))
            continue
        if check.kind == "not_null":
            key = (check.kind, check.table)
        elif check.kind in ("unique", "accepted_values"):
            key = ("values", check.table, check.column)
        else:
            key = ("alone", check.name)
        groups.setdefault(key, []).append(check)

    def counted(key: tuple, group: Sequence[Check]) -> DataFrame:
        if key[0] == "not_null":
            return _null_failures(group, tables[key[1]])
        return _value_failures(group, tables[key[1]]) if key[0] == "values" else _failures(group[0], tables)

    rows = []
    if groups:
        try:
            rows = reduce(DataFrame.union, [counted(k, g) for k, g in groups.items()]).collect()
        except PySparkException:
            # Some check does not run: each on its own, to tell which.
            for check in (c for group in groups.values() for c in group):
                try:
                    rows += _failures(check, tables).collect()
                except PySparkException as e:
                    errors.append(_error(check, e))
    done = [
        (r["name"], r["kind"], "fail" if r["failures"] else "pass", r["failures"], f"{r['failures']:,} failures" if r["failures"] else None)
        for r in rows
    ]
    return local_frame(spark, done + errors, REPORT_SCHEMA)


def _error(check: Check, error: Exception) -> tuple:
    return (check.name, check.kind, "error", None, str(error).splitlines()[0])


def totals(report: DataFrame) -> DataFrame:
    """One row: checks passed, failed, in error and in all."""
    has = lambda s: F.count_if(F.col("status") == s)
    return report.agg(
        has("pass").alias("passed"), has("fail").alias("failed"), has("error").alias("errors"),
        F.count(F.lit(1)).alias("checks"),
    )


def suggest_checks(profile: DataFrame) -> DataFrame:
    """Checks the profile supports: ``(table_name, column_name, kind)``.

    A key is not null and unique, a column without NULLs is not null, anything else gets no check.
    """
    kinds = F.when(F.col("is_candidate_key"), F.array(F.lit("not_null"), F.lit("unique"))).when(
        F.col("null_rate") == 0, F.array(F.lit("not_null"))
    )
    return profile.select("table_name", F.col("name").alias("column_name"), F.explode(kinds).alias("kind"))

"""Guarded SQL, single and chained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemill.plans.guarded import GuardedSession
from tidemill.queries.registry import catalog_tables, query
from tidemill.session import local_frame

_SEGMENTS = """
    SELECT c.c_mktsegment, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total
    FROM {0}orders o JOIN {0}customer c ON o.o_custkey = c.c_custkey
    GROUP BY c.c_mktsegment HAVING count(*) > 1
"""


def guarded_session(spark: SparkSession, sf_dir: str) -> tuple[GuardedSession, str]:
    db = catalog_tables(spark, sf_dir, "tm_query_marts", ["customer", "orders"])
    return GuardedSession(spark, [db]), db


@query("guarded_query", _SEGMENTS.format(""))
def guarded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    session, db = guarded_session(spark, sf_dir)
    outcome = session.run(_SEGMENTS.format(f"{db}.") + ";")
    if not outcome.ok:
        raise RuntimeError(outcome.refusal)
    return outcome.frame


@query("capped_rows", "SELECT least(count(*), 1000) AS n_rows, count(*) > 1000 AS truncated FROM orders")
def capped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of a result are shown, and whether there were more."""
    session, db = guarded_session(spark, sf_dir)
    shown = session.run(f"SELECT o_orderkey, o_totalprice FROM {db}.orders").provenance
    return local_frame(spark, [(shown.row_count, shown.truncated)], "n_rows long, truncated boolean")


_TOP = "SELECT o_custkey, sum(o_totalprice) AS spend FROM {}orders GROUP BY o_custkey ORDER BY spend DESC, o_custkey LIMIT 10"
_THEIRS = """
    SELECT o.o_orderpriority, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total
    FROM {}orders o JOIN {} t ON o.o_custkey = t.o_custkey GROUP BY o.o_orderpriority
"""


@query("chain_hops", f"WITH hop_1_result AS ({_TOP.format('')}) {_THEIRS.format('', 'hop_1_result')}")
def chain_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top customers, then their orders."""
    session, db = guarded_session(spark, sf_dir)
    return session.chain([_TOP.format(f"{db}."), _THEIRS.format(f"{db}.", "hop_1_result")]).frame


_URGENT = "SELECT o_custkey, o_orderkey, o_totalprice FROM {}orders WHERE o_orderpriority = '1-URGENT'"
_BY_SEGMENT = """
    SELECT c.c_mktsegment, count(*) AS n_urgent, round(avg(t.o_totalprice), 4) AS avg_price
    FROM {} t JOIN {}customer c ON t.o_custkey = c.c_custkey GROUP BY c.c_mktsegment
"""


@query("chain_turns", f"WITH turn_1_result AS ({_URGENT.format('')}) {_BY_SEGMENT.format('turn_1_result', '')}")
def chain_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first turn, then a second that breaks its whole result down."""
    session, db = guarded_session(spark, sf_dir)
    session.turn([_URGENT.format(f"{db}.")])
    return session.turn([_BY_SEGMENT.format("turn_1_result", f"{db}.")]).frame


_REPEATING = """
    SELECT c.c_mktsegment, sum(c.c_acctbal) AS balance, count(*) AS n_orders, sum(o.o_totalprice) AS spend
    FROM {0}customer c JOIN {0}orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment
"""
_REDUCED = """
    SELECT c.c_mktsegment, sum(c.c_acctbal) AS balance, count(*) AS n_customers, sum(o.spend) AS spend
    FROM {0}customer c JOIN (SELECT o_custkey, sum(o_totalprice) AS spend FROM {0}orders GROUP BY o_custkey) o
    ON c.c_custkey = o.o_custkey GROUP BY c.c_mktsegment
"""


@query(
    "guarded_fanout",
    """
    SELECT unnest(['balance', 'n_orders']) AS column_name, max(n)::DOUBLE AS most
    FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) HAVING max(n) > 1
    """,
)
def guarded_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which results a join has multiplied: those of customers, not those of orders, and none of orders reduced first."""
    session, db = guarded_session(spark, sf_dir)
    warnings = [w for sql in (_REPEATING, _REDUCED) for w in session.run(sql.format(f"{db}.")).warnings]
    rows = [(w["column_name"], w["high"]) for w in warnings if w["kind"] == "join_fanout"]
    return local_frame(spark, rows, "column_name string, most double")


_IN_CTE = """
    WITH joined AS (SELECT c.c_mktsegment, c.c_acctbal AS balance, o.o_totalprice FROM {0}customer c JOIN {0}orders o ON c.c_custkey = o.o_custkey)
    SELECT c_mktsegment, sum(balance + 1) AS balance, sum(o_totalprice) AS spend FROM (SELECT * FROM joined ORDER BY balance) GROUP BY c_mktsegment
"""


@query("guarded_fanout_cte", "SELECT 'balance' AS column_name, max(n)::DOUBLE AS most FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) HAVING max(n) > 1")
def guarded_fanout_cte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same behind a common table, a renamed column and a sort."""
    session, db = guarded_session(spark, sf_dir)
    rows = [(w["column_name"], w["high"]) for w in session.run(_IN_CTE.format(f"{db}.")).warnings if w["kind"] == "join_fanout"]
    return local_frame(spark, rows, "column_name string, most double")

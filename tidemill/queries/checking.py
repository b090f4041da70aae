"""Data checks, expectations, monitoring and result checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import checks, monitoring
from tidemill.operators.expectations import expect
from tidemill.operators.joins import fanout
from tidemill.operators.profiling import profile_many_columns
from tidemill.operators.sanity import result_sanity
from tidemill.queries.marts import STATS_BY_NATION_SQL, stats_by_nation
from tidemill.queries.profiling import CUSTOMER, LABELLED, profile_sql
from tidemill.queries.registry import layers, query, read
from tidemill.queries.relational import DOCUMENT_LABELS_SQL, document_labels
from tidemill.session import new_scratch
from tidemill.sinks.landing import save_table


def checked_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {
        "labelled": document_labels(spark, sf_dir),
        "orders": read(spark, sf_dir, "orders"),
        "customer": read(spark, sf_dir, "customer"),
        # Not every document is labelled, so that some are orphans.
        "documents": read(spark, sf_dir, "documents"),
        "labels": read(spark, sf_dir, "labels"),
    }


@query("check_not_null", f"SELECT * FROM ({DOCUMENT_LABELS_SQL}) WHERE quality IS NULL")
def check_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.failing_rows(checks.not_null("labelled", "quality"), checked_tables(spark, sf_dir))


@query(
    "check_unique",
    "SELECT o_custkey AS value, count(*) AS n_rows FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
)
def check_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.failing_rows(checks.unique("orders", "o_custkey"), checked_tables(spark, sf_dir))


@query(
    "check_accepted_values",
    "SELECT o_orderstatus AS value, count(*) AS n_rows FROM orders WHERE o_orderstatus NOT IN ('O', 'F') GROUP BY 1",
)
def check_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.failing_rows(checks.accepted_values("orders", "o_orderstatus", ["O", "F"]), checked_tables(spark, sf_dir))


_ORPHANS_SQL = """
    SELECT * FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM labels)
"""


@query("check_relationship", _ORPHANS_SQL)
def check_relationship(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = checks.relationship("documents", "doc_id", "labels", "doc_id")
    return checks.failing_rows(check, checked_tables(spark, sf_dir))


@query("check_singular", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 499000")
def check_singular(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").where("o_totalprice > 499000").select("o_orderkey", "o_totalprice")
    return checks.failing_rows(checks.singular("no_huge_orders", rows), {})


@query(
    "suggest_checks",
    f"""
    SELECT table_name, name AS column_name, unnest(CASE WHEN is_candidate_key THEN ['not_null', 'unique']
           WHEN null_rate = 0 THEN ['not_null'] ELSE [] END) AS kind
    FROM ({profile_sql('customer', CUSTOMER)} UNION ALL {profile_sql('labelled', LABELLED, f'({DOCUMENT_LABELS_SQL})')})
    """,
)
def suggest_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"customer": read(spark, sf_dir, "customer"), "labelled": document_labels(spark, sf_dir)}
    return checks.suggest_checks(profile_many_columns(tables))


_FAILURES_SQL = f"""
    SELECT 'not_null_labelled_doc_id' AS name, 'not_null' AS kind, count(*) FILTER (doc_id IS NULL) AS failures FROM ({DOCUMENT_LABELS_SQL})
    UNION ALL SELECT 'not_null_labelled_quality', 'not_null', count(*) FILTER (quality IS NULL) FROM ({DOCUMENT_LABELS_SQL})
    UNION ALL SELECT 'unique_labelled_doc_id', 'unique', count(*) - count(DISTINCT doc_id) FROM ({DOCUMENT_LABELS_SQL})
    UNION ALL SELECT 'unique_orders_o_custkey', 'unique', count(*) FROM
        (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'accepted_values_orders_o_orderstatus_O_F', 'accepted_values', count(DISTINCT o_orderstatus) FROM orders
        WHERE o_orderstatus NOT IN ('O', 'F')
    UNION ALL SELECT 'relationship_documents_doc_id_labels_doc_id', 'relationship', count(*) FROM ({_ORPHANS_SQL})
    UNION ALL SELECT 'relationship_orders_o_custkey_customer_c_custkey', 'relationship', count(*) FROM orders
        WHERE o_custkey IS NOT NULL AND o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'no_huge_orders', 'singular', count(*) FROM orders WHERE o_totalprice > 499000
    UNION ALL SELECT 'cannot_run', 'singular', NULL
"""


@query(
    "run_checks",
    f"SELECT name, kind, CASE WHEN failures IS NULL THEN 'error' WHEN failures = 0 THEN 'pass' ELSE 'fail' END AS status, failures FROM ({_FAILURES_SQL})",
)
def run_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suite with one check of every kind, some of which fail and one that ends with an error."""
    tables = checked_tables(spark, sf_dir)
    suite = [
        checks.not_null("labelled", "doc_id"),
        checks.not_null("labelled", "quality"),
        checks.unique("labelled", "doc_id"),
        checks.unique("orders", "o_custkey"),
        checks.accepted_values("orders", "o_orderstatus", ["O", "F"]),
        checks.relationship("documents", "doc_id", "labels", "doc_id"),
        checks.relationship("orders", "o_custkey", "customer", "c_custkey"),
        checks.singular("no_huge_orders", tables["orders"].where("o_totalprice > 499000")),
        checks.singular("cannot_run", tables["orders"].where("CAST(o_orderpriority AS INT) > 0")),
    ]
    return checks.run_checks(spark, suite, tables).drop("message")


@query("failing_rows", f"{_ORPHANS_SQL} ORDER BY doc_id LIMIT 5")
def failing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five examples of a failing check."""
    check = checks.relationship("documents", "doc_id", "labels", "doc_id")
    return checks.failing_rows(check, checked_tables(spark, sf_dir), limit=5, order=["doc_id"])


@query(
    "expect_result",
    f"""
    WITH s AS ({STATS_BY_NATION_SQL}), first AS (SELECT * FROM s ORDER BY avg_value DESC, nation_name LIMIT 1)
    SELECT 'row_count' AS expectation, count(*) = 25 AS ok FROM s
    UNION ALL SELECT 'min_rows', count(*) >= 20 FROM s
    UNION ALL SELECT 'columns', count(*) > 0 FROM s
    UNION ALL SELECT 'all_positive.n_rows', count(*) FILTER (n_rows > 0) = count(*) FROM s
    UNION ALL SELECT 'all_positive.min_value', count(*) FILTER (min_value > 0) = count(*) FROM s
    UNION ALL SELECT 'first_row.nation_name', nation_name = 'NATION_0' FROM first
    """,
)
def expect_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of the flagship mart, some of which do not hold."""
    return expect(
        stats_by_nation(spark, sf_dir),
        row_count=25,
        min_rows=20,
        columns=["nation_name", "n_rows"],
        first_row={"nation_name": "NATION_0"},
        all_positive=["n_rows", "min_value"],
    )


# Monitoring ------------------------------------------------------------------------------------


def _operated(spark: SparkSession, sf_dir: str):
    """A dataset with two raw tables, a staging view and a mart."""
    from tidemill.sinks.models import save_view

    built = layers(spark, "tm_watch")
    save_table(read(spark, sf_dir, "customer"), built.raw, "customer")
    save_table(read(spark, sf_dir, "orders"), built.raw, "orders")
    save_view(spark, built.staging, "stg_orders", f"SELECT * FROM {built.raw}.orders WHERE o_totalprice > 100000")
    save_table(stats_by_nation(spark, sf_dir), built.marts, "mart_stats_by_nation")
    return built


@query(
    "rowcount_snapshot",
    f"""
    SELECT 'tm_watch_raw.customer' AS table_name, count(*) AS n_rows FROM customer
    UNION ALL SELECT 'tm_watch_raw.orders', count(*) FROM orders
    UNION ALL SELECT 'tm_watch_staging.stg_orders', count(*) FROM orders WHERE o_totalprice > 100000
    UNION ALL SELECT 'tm_watch_marts.mart_stats_by_nation', count(*) FROM ({STATS_BY_NATION_SQL})
    """,
)
def rowcount_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.rowcount_snapshot(spark, _operated(spark, sf_dir).databases)


@query(
    "dataset_metrics",
    """
    SELECT CAST(2 AS BIGINT) AS n_sources, CAST(1 AS BIGINT) AS n_staging, CAST(1 AS BIGINT) AS n_marts,
           (SELECT count(*) FROM customer) + (SELECT count(*) FROM orders) AS raw_rows
    """,
)
def dataset_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return monitoring.dataset_metrics(monitoring.rowcount_snapshot(spark, _operated(spark, sf_dir).databases))


@query(
    "rowcount_drift",
    """
    WITH p AS (SELECT o_orderpriority AS table_name, count(*) AS n FROM orders
               WHERE o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority <> '1-URGENT' GROUP BY 1),
    c AS (SELECT o_orderpriority AS table_name, count(*) AS n FROM orders
          WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderpriority <> '5-LOW' GROUP BY 1),
    b AS (SELECT coalesce(p.table_name, c.table_name) AS table_name, p.n AS previous_rows, c.n AS current_rows
          FROM p FULL JOIN c ON p.table_name = c.table_name)
    SELECT table_name, CASE WHEN previous_rows IS NULL THEN 'new' WHEN current_rows IS NULL THEN 'dropped'
               WHEN current_rows > previous_rows THEN 'up' ELSE 'down' END AS kind,
           previous_rows, current_rows, round((current_rows - previous_rows) / previous_rows, 6) AS change
    FROM b WHERE previous_rows IS NULL OR current_rows IS NULL
       OR abs((current_rows - previous_rows) / previous_rows) >= 0.2
    """,
)
def rowcount_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two saved snapshots of order counts, before and after a date, compared."""
    path = new_scratch(spark, "snapshots")
    orders = read(spark, sf_dir, "orders")
    runs = {
        "previous": "o_orderdate < TIMESTAMP_NTZ '1997-01-01' AND o_orderpriority <> '1-URGENT'",
        "current": "o_orderdate >= TIMESTAMP_NTZ '1997-01-01' AND o_orderpriority <> '5-LOW'",
    }
    for run_id, condition in runs.items():
        counts = orders.where(condition).groupBy(F.col("o_orderpriority").alias("table_name"))
        monitoring.save_snapshot(counts.agg(F.count(F.lit(1)).alias("n_rows")), path, run_id)
    previous, current = (monitoring.load_snapshot(spark, path, r) for r in runs)
    drift = monitoring.rowcount_drift(previous, current)
    return drift.withColumn("change", F.round("change", 6))


# Result checks ---------------------------------------------------------------------------------


@query(
    "fanout_check",
    """
    WITH k AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1)
    SELECT count(*) AS parent_rows, count(n) AS matched_rows, CAST(coalesce(sum(n), 0) AS BIGINT) AS joined_rows,
           coalesce(max(n), 0) AS max_children, round(sum(n) / count(n), 6) AS fanout_factor,
           round(sum(c_acctbal) FILTER (n IS NOT NULL), 2) AS sum_before, round(sum(c_acctbal * n), 2) AS sum_after,
           sum(n) > count(n) AS fanout_risk
    FROM customer LEFT JOIN k ON c_custkey = o_custkey
    """,
)
def fanout_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = fanout(
        read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders"), "c_custkey", "o_custkey", measure="c_acctbal"
    )
    rounded = {"sum_before": F.round("sum_before", 2), "sum_after": F.round("sum_after", 2)}
    return measured.withColumns({**rounded, "fanout_factor": F.round("fanout_factor", 6)})


@query(
    "result_sanity",
    """
    WITH r AS (SELECT o_custkey, count(*) - 10 AS n_above_ten, round(avg(o_totalprice) / 1000, 4) AS price_rate
               FROM orders GROUP BY o_custkey)
    SELECT 'negative_count' AS kind, 'n_above_ten' AS column_name, CAST(lo AS DOUBLE) AS low, CAST(hi AS DOUBLE) AS high
    FROM (SELECT min(n_above_ten) AS lo, max(n_above_ten) AS hi FROM r) WHERE lo < 0
    UNION ALL
    SELECT 'out_of_range', 'price_rate', lo, hi FROM (SELECT min(price_rate) AS lo, max(price_rate) AS hi FROM r)
    WHERE lo < 0 OR hi > 100
    """,
)
def result_sanity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result with a count below zero and a rate above 100."""
    result = (
        read(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            (F.count(F.lit(1)) - 10).alias("n_above_ten"), F.round(F.avg("o_totalprice") / 1000, 4).alias("price_rate")
        )
    )
    return result_sanity(result)

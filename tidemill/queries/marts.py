"""Marts, reports and the standing questions, on customers by nation and on orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.joins import join_preaggregated
from tidemill.plans import golden, marts, reports
from tidemill.queries.registry import query, read
from tidemill.queries.relational import DOCUMENT_LABELS_SQL, document_labels, stage_curated

STATS_BY_NATION_SQL = """
    SELECT n_name AS nation_name, count(*) AS n_rows, count(c_acctbal) AS n_with_value,
           round(avg(c_acctbal), 6) AS avg_value, round(median(c_acctbal), 6) AS median_value,
           max(c_acctbal) AS max_value, min(c_acctbal) AS min_value, round(avg(c_custkey), 6) AS avg_second
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name HAVING count(c_acctbal) > 0
"""

# Total quantity of an order against its price: least squares from plain sums.
OUTLIERS_SQL = """
    WITH sized AS (
        SELECT o_orderkey, o_orderpriority, (SELECT sum(l_quantity) FROM lineitem WHERE l_orderkey = o_orderkey) AS quantity,
               o_totalprice FROM orders),
    points AS (SELECT *, ln(quantity) AS u, ln(o_totalprice) AS v FROM sized WHERE quantity > 0 AND o_totalprice > 0),
    sums AS (SELECT count(*) AS n, avg(u) AS mu, avg(v) AS mv FROM points),
    line AS (SELECT sum((u - mu) * (v - mv)) / sum((u - mu) * (u - mu)) AS b, any_value(mu) AS mu, any_value(mv) AS mv
             FROM points, sums),
    placed AS (SELECT points.*, mv + b * (u - mu) AS expected FROM points, line)
    SELECT o_orderkey, o_orderpriority, quantity, o_totalprice, round(exp(expected), 2) AS predicted_value,
           round(o_totalprice - exp(expected), 2) AS value_gap, round(exp(v - expected), 3) AS value_ratio,
           round(v - expected, 4) AS residual_ln,
           row_number() OVER (ORDER BY v - expected DESC, o_orderkey) AS overperformer_rank
    FROM placed
"""


def stats_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    # More digits than the mart shows by default: engines disagree on rounding at exact halves.
    return marts.stats_by_group(
        stage_curated(spark, sf_dir), "nation_name", "account_balance", "customer_id", digits=6, second_digits=6
    )


def order_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their total quantity; lines are reduced to one row per order before the join."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    lines = read(spark, sf_dir, "lineitem")
    return join_preaggregated(
        orders, lines, "o_orderkey", "l_orderkey", [F.sum("l_quantity").alias("quantity")], how="inner"
    )


def order_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.power_law_outliers(
        order_sizes(spark, sf_dir), "o_orderkey", "quantity", "o_totalprice", ["o_orderpriority"], write_base=True
    )


def order_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.power_law_scores(
        order_sizes(spark, sf_dir), "o_orderkey", "quantity", "o_totalprice", ["o_orderpriority"], write_base=True
    )


@query("mart_stats_by_group", STATS_BY_NATION_SQL)
def mart_stats_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: account balances by nation."""
    return stats_by_nation(spark, sf_dir)


@query("mart_power_law_outliers", OUTLIERS_SQL)
def mart_power_law_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_outliers(spark, sf_dir)


PROJECTION_SQL = f"""
    SELECT doc_id, lang, n_chars, quality, toxic FROM ({DOCUMENT_LABELS_SQL})
    WHERE n_chars IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL)
"""


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.filtered_projection(
        document_labels(spark, sf_dir),
        ["doc_id", "lang", "n_chars", "quality", "toxic"],
        required="n_chars",
        any_of=["quality", "toxic"],
        order=[F.desc_nulls_last("n_chars"), F.asc("doc_id")],
    )


@query("mart_filtered_projection", PROJECTION_SQL)
def mart_filtered_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_documents(spark, sf_dir)


@query(
    "mart_ratio_by_group",
    f"""
    SELECT o_orderpriority, count(*) AS n_rows, round(avg(value_ratio), 3) AS avg_ratio
    FROM ({OUTLIERS_SQL}) GROUP BY o_orderpriority HAVING count(*) >= 10
    """,
)
def mart_ratio_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marts.ratio_by_group(order_scores(spark, sf_dir), "o_orderpriority")


@query(
    "report_top_groups",
    f"""
    SELECT nation_name, n_rows, n_with_value, avg_value, max_value FROM ({STATS_BY_NATION_SQL})
    WHERE n_with_value >= 5 ORDER BY avg_value DESC, nation_name LIMIT 20
    """,
)
def report_top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_groups(stats_by_nation(spark, sf_dir), "nation_name")


@query(
    "report_power_trend",
    f"""
    WITH p AS (SELECT o_orderkey, quantity, o_totalprice FROM ({OUTLIERS_SQL})),
    fit AS (SELECT regr_slope(ln(o_totalprice), ln(quantity)) AS slope,
                   regr_intercept(ln(o_totalprice), ln(quantity)) AS intercept FROM p)
    SELECT o_orderkey, quantity, o_totalprice, round(exp(intercept) * pow(quantity, slope), 2) AS trend
    FROM p CROSS JOIN fit
    """,
)
def report_power_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scatter points with the fitted curve."""
    points = order_sizes(spark, sf_dir).select("o_orderkey", "quantity", "o_totalprice")
    return reports.power_trend(points, "quantity", "o_totalprice")


@query(
    "report_mart_frame",
    f"SELECT doc_id, lang, n_chars, quality, toxic FROM ({PROJECTION_SQL}) ORDER BY n_chars DESC, doc_id LIMIT 100",
)
def report_mart_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a mart that has more than are shown."""
    return reports.mart_frame(labelled_documents(spark, sf_dir), 100)


# Standing questions ----------------------------------------------------------------------------

_SHOWN = ["o_orderkey", "o_orderpriority", "value_ratio", "overperformer_rank"]


@query(
    "golden_largest_for_size",
    f"SELECT {', '.join(_SHOWN)} FROM ({OUTLIERS_SQL}) ORDER BY overperformer_rank LIMIT 5",
)
def golden_largest_for_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.largest_for_size(order_scores(spark, sf_dir), "o_orderkey", _SHOWN)


@query(
    "golden_top_overperformer",
    f"SELECT o_orderkey, value_ratio FROM ({OUTLIERS_SQL}) WHERE overperformer_rank = 1",
)
def golden_top_overperformer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.top_overperformer(order_scores(spark, sf_dir), "o_orderkey", ["o_orderkey", "value_ratio"])


@query(
    "golden_rank_of",
    f"SELECT o_orderkey, overperformer_rank FROM ({OUTLIERS_SQL}) WHERE o_orderkey = 7",
)
def golden_rank_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.rank_of(order_outliers(spark, sf_dir), "o_orderkey", 7)


@query("golden_rows_per_group", f"SELECT nation_name, n_rows FROM ({STATS_BY_NATION_SQL})")
def golden_rows_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.rows_per_group(stats_by_nation(spark, sf_dir), "nation_name")


@query(
    "golden_largest_group",
    f"SELECT nation_name, n_rows FROM ({STATS_BY_NATION_SQL}) ORDER BY n_rows DESC, nation_name LIMIT 1",
)
def golden_largest_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.largest_group(stats_by_nation(spark, sf_dir), "nation_name")


@query(
    "golden_average_of",
    f"SELECT nation_name, avg_value FROM ({STATS_BY_NATION_SQL}) WHERE nation_name = 'NATION_3'",
)
def golden_average_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.average_of(stats_by_nation(spark, sf_dir), "nation_name", "NATION_3")


@query(
    "golden_group_with_maximum",
    f"SELECT nation_name, max_value FROM ({STATS_BY_NATION_SQL}) ORDER BY max_value DESC, nation_name LIMIT 1",
)
def golden_group_with_maximum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.group_with_maximum(stats_by_nation(spark, sf_dir), "nation_name")


@query(
    "golden_present_rows",
    f"""
    SELECT doc_id, n_chars, quality FROM ({PROJECTION_SQL}) WHERE quality IS NOT NULL
    ORDER BY n_chars DESC, doc_id LIMIT 10
    """,
)
def golden_present_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.present_rows(
        labelled_documents(spark, sf_dir),
        "quality",
        ["doc_id", "n_chars", "quality"],
        [F.desc_nulls_last("n_chars"), F.asc("doc_id")],
    )


@query("golden_total_rows", f"SELECT CAST(sum(n_rows) AS BIGINT) AS total_rows FROM ({STATS_BY_NATION_SQL})")
def golden_total_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden.total_rows(stats_by_nation(spark, sf_dir))

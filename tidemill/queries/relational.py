"""Projections, filters, joins, aggregates, ranks, set operations, functions and table functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.columns import text_key
from tidemill.operators import sets
from tidemill.operators.joins import join_preaggregated, with_scalars
from tidemill.operators.ranking import global_rank, grouped_median, top_k, top_values
from tidemill.plans.staging import any_missing_dropped, cast_rejects, clean_names, present_any, stage_columns, stage_names
from tidemill.queries.registry import query, read

DOCUMENT_LABELS_SQL = """
    SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""


def document_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels, NULL where unlabelled: the given tables hold no NULLs themselves."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return documents.join(read(spark, sf_dir, "labels"), "doc_id", "left")


# Staging ---------------------------------------------------------------------------------------

_AWKWARD = ["Customer Key", "Customer-Name (full)", "Nation/Key", "2nd Acct Bal", "order"]


@query(
    "stage_snake_case",
    """
    SELECT c_custkey AS customer_key, c_name AS customer_name_full, c_nationkey AS nation_key,
           c_acctbal AS c_2nd_acct_bal, c_mktsegment AS order_ FROM customer
    """,
)
def stage_snake_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_names(read(spark, sf_dir, "customer").toDF(*_AWKWARD))


@query(
    "stage_dedupe_names",
    """
    SELECT o_orderkey AS key, o_custkey AS key_2, o_orderstatus AS key_1, o_totalprice AS price,
           o_orderdate AS price_1, o_orderpriority AS priority FROM orders
    """,
)
def stage_dedupe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that fall together, one of them on a name that is already taken."""
    names = clean_names(["key", "Key", "key_1", "price", "Price!", "Priority"])
    return read(spark, sf_dir, "orders").toDF(*names)


@query("stage_table", "SELECT * FROM orders")
def stage_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 1:1 staging model of a raw table, read through its view."""
    from tidemill.sinks.models import create_view

    raw = read(spark, sf_dir, "orders")
    create_view(stage_names(raw.toDF(*[c.replace("_", " ").upper() for c in raw.columns])), "tm_stg_orders")
    return spark.table("tm_stg_orders")


@query(
    "stage_curated",
    """
    SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, c.c_mktsegment AS segment,
           c.c_acctbal AS account_balance, n.n_name AS nation_name,
           nullif(trim(c.c_mktsegment || ' ' || n.n_name), '') AS market
    FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
    """,
)
def stage_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renames, a cast, a derived key and the junk filter."""
    raw = read(spark, sf_dir, "customer").join(
        read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return stage_columns(
        raw,
        {
            "c_custkey": "customer_id", "c_name": "customer_name", "c_mktsegment": "segment",
            "c_acctbal": "account_balance", "n_name": "nation_name",
        },
        casts={"customer_id": "bigint"},
        derived={"market": text_key(F.col("c_mktsegment"), F.col("n_name"))},
        required=["customer_id", "nation_name"],
    )


@query(
    "stage_rejects",
    """
    SELECT 'item' AS column_name, count(*) AS n_rows FROM part WHERE p_partkey > 127
    UNION ALL SELECT 'label', count(*) FROM part WHERE try_cast(p_brand AS INTEGER) IS NULL AND p_brand IS NOT NULL
    """,
)
def stage_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lenient casts would turn into NULLs, by column."""
    rejects = cast_rejects(
        read(spark, sf_dir, "part"), {"p_partkey": "item", "p_brand": "label"}, {"item": "tinyint", "label": "int"}
    )
    rows = rejects.select(F.explode("rejected").alias("column_name"))
    return rows.groupBy("column_name").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "derive_text_key",
    """
    SELECT p_partkey, nullif(trim(p_brand || ' ' || p_type), '') AS part_label,
           nullif(trim(nullif(p_brand, 'Brand#7') || ' ' || p_name), '') AS maybe_label FROM part
    """,
)
def derive_text_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key from two texts; NULL in one makes the key NULL."""
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        text_key(F.col("p_brand"), F.col("p_type")).alias("part_label"),
        text_key(F.nullif(F.col("p_brand"), F.lit("Brand#7")), F.col("p_name")).alias("maybe_label"),
    )


# Filters ---------------------------------------------------------------------------------------


@query(
    "filter_range",
    """
    SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity > 10 AND l_quantity <= 20 AND l_discount > 0
    """,
)
def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "lineitem")
        .where("l_returnflag = 'R' AND l_quantity > 10 AND l_quantity <= 20 AND l_discount > 0")
        .select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate")
    )


@query(
    "filter_not_null", f"SELECT * FROM ({DOCUMENT_LABELS_SQL}) WHERE quality IS NOT NULL AND lang IS NOT NULL"
)
def filter_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return any_missing_dropped(document_labels(spark, sf_dir), ["quality", "lang"])


@query(
    "filter_any_present",
    f"""
    WITH d AS (SELECT doc_id, n_chars, nullif(lang, 'en') AS lang, nullif(source, 'src0') AS source, quality
               FROM ({DOCUMENT_LABELS_SQL}))
    SELECT * FROM d WHERE n_chars IS NOT NULL AND (lang IS NOT NULL OR source IS NOT NULL OR quality IS NOT NULL)
    """,
)
def filter_any_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_labels(spark, sf_dir).select(
        "doc_id",
        "n_chars",
        F.nullif("lang", F.lit("en")).alias("lang"),
        F.nullif("source", F.lit("src0")).alias("source"),
        "quality",
    )
    return d.where(F.col("n_chars").isNotNull() & present_any(["lang", "source", "quality"]))


@query(
    "filter_scalar_subquery",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
)
def filter_scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return orders.where(F.col("o_totalprice") > orders.agg(F.avg("o_totalprice")).scalar())


@query(
    "filter_in_subquery",
    """
    SELECT c_custkey, c_name FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000)
    """,
)
def filter_in_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subquery's keys are made distinct first: a semi-join would shuffle every copy of a frequent key."""
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 400000")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return customers.join(urgent.select("o_custkey").distinct(), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@query(
    "having_filter",
    "SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY o_custkey HAVING count(*) > 12",
)
def having_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"))
    return counts.where("n_orders > 12")


# Joins -----------------------------------------------------------------------------------------


@query(
    "join_inner",
    """
    SELECT o.o_orderkey, o.o_totalprice, c.c_custkey, c.c_mktsegment
    FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
    """,
)
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).select(
        "o_orderkey", "o_totalprice", "c_custkey", "c_mktsegment"
    )


@query(
    "join_cross_scalar",
    """
    SELECT c_custkey, c_acctbal, n_fit, round(c_acctbal - mean_balance, 4) AS above_mean
    FROM customer CROSS JOIN (SELECT avg(c_acctbal) AS mean_balance, count(*) AS n_fit FROM customer)
    """,
)
def join_cross_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row against a one-row fit, as a scalar subquery."""
    customer = read(spark, sf_dir, "customer")
    fit = customer.agg(F.avg("c_acctbal").alias("mean_balance"), F.count(F.lit(1)).alias("n_fit"))
    return with_scalars(customer, fit).select(
        "c_custkey", "c_acctbal", "n_fit", F.round(F.col("c_acctbal") - F.col("mean_balance"), 4).alias("above_mean")
    )


@query(
    "join_preaggregated",
    """
    SELECT c.c_custkey, c.c_name, c.c_acctbal, o.n_orders, o.total_spend
    FROM customer c LEFT JOIN (
        SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total_spend
        FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY o_custkey) o ON c.c_custkey = o.o_custkey
    """,
)
def join_preaggregated_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    urgent = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return join_preaggregated(
        customer,
        urgent,
        "c_custkey",
        "o_custkey",
        [F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total_spend")],
    )


# Aggregates ------------------------------------------------------------------------------------


@query(
    "agg_count",
    """
    SELECT event_type, count(*) AS n FROM events GROUP BY event_type
    UNION ALL SELECT 'all', count(*) FROM events
    """,
)
def agg_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group sizes and the total, which is summed from them instead of a second scan."""
    groups = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return groups.union(groups.agg(F.lit("all").alias("event_type"), F.sum("n").alias("n")))


@query(
    "agg_null_stats",
    f"""
    SELECT lang, count(*) AS n_rows, count(quality) AS n_with_quality, count(*) - count(quality) AS n_null,
           round((count(*) - count(quality)) / count(*), 4) AS null_rate
    FROM ({DOCUMENT_LABELS_SQL}) GROUP BY lang
    """,
)
def agg_null_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, present = F.count(F.lit(1)), F.count("quality")
    return (
        document_labels(spark, sf_dir)
        .groupBy("lang")
        .agg(
            n.alias("n_rows"), present.alias("n_with_quality"), (n - present).alias("n_null"),
            F.round((n - present) / n, 4).alias("null_rate"),
        )
    )


@query(
    "agg_count_distinct",
    """
    SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY o_orderpriority
    """,
)
def agg_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n_customers"))


@query(
    "agg_approx_distinct",
    """
    SELECT count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT o_custkey) AS n_customers,
           true AS orders_close, true AS customers_close FROM orders
    """,
)
def agg_approx_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimates differ between engines, so the answer is how far off they may be: 10 %."""
    orders = read(spark, sf_dir, "orders")
    near = orders.agg(
        F.approx_count_distinct("o_orderkey", 0.02).alias("a"), F.approx_count_distinct("o_custkey", 0.02).alias("b")
    )
    # Distinct rows first: as aggregates of one pass, each distinct key would hold sketches of its own.
    counted = lambda c, name: orders.select(c).distinct().agg(F.count(c).alias(name))
    exact = with_scalars(counted("o_orderkey", "n_orders"), counted("o_custkey", "n_customers"))
    both = with_scalars(exact, near)
    close = lambda a, n: F.abs(F.col(a) - F.col(n)) / F.col(n) <= 0.1
    return both.select(
        "n_orders", "n_customers", close("a", "n_orders").alias("orders_close"),
        close("b", "n_customers").alias("customers_close"),
    )


@query(
    "agg_min_max",
    """
    SELECT l_returnflag, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price,
           min(l_shipdate) AS first_shipped, max(l_shipdate) AS last_shipped FROM lineitem GROUP BY l_returnflag
    """,
)
def agg_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag")
        .agg(
            F.min("l_extendedprice").alias("min_price"), F.max("l_extendedprice").alias("max_price"),
            F.min("l_shipdate").alias("first_shipped"), F.max("l_shipdate").alias("last_shipped"),
        )
    )


@query(
    "agg_median",
    """
    SELECT l_returnflag, l_linestatus, median(l_extendedprice) AS median_price
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """,
)
def agg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped_median(
        read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", "median_price"
    )


@query(
    "agg_median_ranged",
    "SELECT l_shipdate, median(l_extendedprice) AS median_price FROM lineitem GROUP BY l_shipdate",
)
def agg_median_ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By ship date: many groups, each in one or two ranges."""
    return grouped_median(read(spark, sf_dir, "lineitem"), ["l_shipdate"], "l_extendedprice", "median_price")


@query("agg_median_global", "SELECT median(l_extendedprice) AS median_price FROM lineitem")
def agg_median_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all rows, without keys."""
    return grouped_median(read(spark, sf_dir, "lineitem"), [], "l_extendedprice", "median_price")


@query(
    "agg_sum",
    """
    SELECT r.r_name AS region, CAST(sum(l.l_linenumber) AS BIGINT) AS lines,
           round(sum(l.l_extendedprice), 2) AS revenue
    FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
    JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name
    """,
)
def agg_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total revenue by region; lines are summed per supplier before anything is joined to them."""
    by_supplier = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_suppkey")
        .agg(F.sum("l_linenumber").alias("lines"), F.sum("l_extendedprice").alias("revenue"))
    )
    return (
        by_supplier.join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("region"))
        .agg(F.sum("lines").alias("lines"), F.round(F.sum("revenue"), 2).alias("revenue"))
    )


@query(
    "agg_regression",
    """
    SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope,
           round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept, count(*) AS n_fit
    FROM lineitem WHERE l_quantity > 0 AND l_extendedprice > 0 GROUP BY l_returnflag
    """,
)
def agg_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    y, x = F.ln("l_extendedprice"), F.ln("l_quantity")
    return (
        read(spark, sf_dir, "lineitem")
        .where("l_quantity > 0 AND l_extendedprice > 0")
        .groupBy("l_returnflag")
        .agg(
            F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"),
            F.count(F.lit(1)).alias("n_fit"),
        )
    )


@query(
    "agg_topk_values",
    """
    SELECT o_custkey AS value, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL
    GROUP BY o_custkey ORDER BY n DESC, value LIMIT 8
    """,
)
def agg_topk_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_values(read(spark, sf_dir, "orders"), "o_custkey")


# Ranks and limits ------------------------------------------------------------------------------


@query(
    "window_global_rank",
    """
    SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS price_rank
    FROM orders
    """,
)
def window_global_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return global_rank(orders, [F.desc_nulls_last("o_totalprice"), F.asc("o_orderkey")], "price_rank")


@query("topk", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20")
def topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    return top_k(customers, [F.desc_nulls_last("c_acctbal"), F.asc("c_custkey")], 20)


# Set operations --------------------------------------------------------------------------------

_LARGE, _URGENT = "o_totalprice > 300000", "o_orderpriority = '1-URGENT'"


def _customers_of(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where(condition).select(F.col("o_custkey").alias("custkey"))


def _set_sql(operator: str) -> str:
    return (
        f"SELECT o_custkey AS custkey FROM orders WHERE {_LARGE} {operator} "
        f"SELECT o_custkey AS custkey FROM orders WHERE {_URGENT}"
    )


@query("set_union", _set_sql("UNION"))
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.union(_customers_of(spark, sf_dir, _LARGE), _customers_of(spark, sf_dir, _URGENT))


@query("set_intersect", _set_sql("INTERSECT"))
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.intersect(_customers_of(spark, sf_dir, _LARGE), _customers_of(spark, sf_dir, _URGENT))


@query("set_except", _set_sql("EXCEPT"))
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.subtract(_customers_of(spark, sf_dir, _LARGE), _customers_of(spark, sf_dir, _URGENT))


# Functions -------------------------------------------------------------------------------------


@query(
    "scalar_math",
    """
    SELECT l_orderkey, l_linenumber, round(ln(l_extendedprice), 6) AS ln_price, round(exp(l_discount), 6) AS exp_discount,
           round(l_extendedprice * (1 - l_discount) + l_tax, 4) AS charge, CAST(l_partkey AS INTEGER) AS part
    FROM lineitem WHERE l_extendedprice > 0
    """,
)
def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        read(spark, sf_dir, "lineitem")
        .where("l_extendedprice > 0")
        .select(
            "l_orderkey",
            "l_linenumber",
            F.round(F.ln("l_extendedprice"), 6).alias("ln_price"),
            F.round(F.exp("l_discount"), 6).alias("exp_discount"),
            F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) + F.col("l_tax"), 4).alias("charge"),
            F.col("l_partkey").cast("int").alias("part"),
        )
    )


@query(
    "scalar_string",
    """
    SELECT c_custkey, upper(c_name) AS upper_name, trim('  ' || c_mktsegment || ' ') AS segment,
           nullif(c_mktsegment, 'BUILDING') AS not_building FROM customer
    """,
)
def scalar_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        F.upper("c_name").alias("upper_name"),
        F.trim(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("segment"),
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("not_building"),
    )


# Table functions -------------------------------------------------------------------------------

_STATUSES = "('O', 'open'), ('F', 'filled'), ('P', 'partial')"


@query(
    "tf_values",
    f"""
    SELECT v.label, count(*) AS n_orders, round(sum(o.o_totalprice), 2) AS total
    FROM orders o JOIN (VALUES {_STATUSES}) v(status, label) ON o.o_orderstatus = v.status GROUP BY v.label
    """,
)
def tf_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline rows as a lookup for all orders."""
    labels = spark.sql(f"SELECT * FROM VALUES {_STATUSES} AS v(status, label)")
    by_status = (
        read(spark, sf_dir, "orders")
        .groupBy("o_orderstatus")
        .agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("total"))
    )
    return by_status.join(labels, F.col("o_orderstatus") == F.col("status")).select(
        "label", "n_orders", F.round("total", 2).alias("total")
    )


@query(
    "tf_series",
    """
    SELECT o.o_orderkey, s.i AS installment, round(o.o_totalprice / o.parts, 4) AS amount
    FROM (SELECT o_orderkey, o_totalprice, o_orderkey % 3 + 1 AS parts FROM orders) o,
         LATERAL (SELECT unnest(generate_series(1, o.parts)) AS i) s
    """,
)
def tf_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A series per order, both ends included."""
    orders = read(spark, sf_dir, "orders").select(
        "o_orderkey", "o_totalprice", (F.col("o_orderkey") % 3 + 1).alias("parts")
    )
    return orders.select(
        "o_orderkey",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("parts"))).alias("installment"),
        F.round(F.col("o_totalprice") / F.col("parts"), 4).alias("amount"),
    )


@query(
    "tf_unnest",
    "SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS component FROM embeddings",
)
def tf_unnest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.explode("embedding").alias("component")).withColumn(
        "component", F.col("component").cast("double")
    )


@query(
    "unpivot_metrics",
    """
    SELECT l_returnflag, 'avg_discount' AS series, round(avg(l_discount), 4) AS value FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'avg_quantity', round(avg(l_quantity), 4) FROM lineitem GROUP BY 1
    UNION ALL SELECT l_returnflag, 'avg_tax', round(avg(l_tax), 4) FROM lineitem GROUP BY 1
    """,
)
def unpivot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide metrics of a mart as series for a chart."""
    metrics = {"avg_discount": "l_discount", "avg_quantity": "l_quantity", "avg_tax": "l_tax"}
    wide = (
        read(spark, sf_dir, "lineitem")
        .groupBy("l_returnflag")
        .agg(*[F.round(F.avg(c), 4).alias(name) for name, c in metrics.items()])
    )
    return wide.unpivot(["l_returnflag"], list(metrics), "series", "value")

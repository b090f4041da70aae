"""A whole run over a dataset of the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import checks
from tidemill.plans.marts import stats_by_group
from tidemill.plans.operate import Plan, operate
from tidemill.queries.registry import query
from tidemill.session import new_scratch
from tidemill.sinks.landing import Dataset, TableSpec

_SOURCES = ["customer", "orders", "nation"]

_CUSTOMERS = """
    SELECT c.c_custkey AS customer_id, c.c_acctbal AS account_balance, n.n_name AS nation_name
    FROM {raw}.customer c JOIN {raw}.nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_custkey IS NOT NULL
"""


def sales_plan(spark: SparkSession, sf_dir: str, state: str | None = None) -> Plan:
    return Plan(
        Dataset("tm_daily", [TableSpec(f"{sf_dir}/{t}.parquet", t) for t in _SOURCES], new_scratch(spark, "daily")),
        staging={"stg_customer": _CUSTOMERS},
        marts={
            "mart_balance_by_nation": lambda t: stats_by_group(
                t["stg_customer"], "nation_name", "account_balance", "customer_id"
            )
        },
        checks=[
            checks.not_null("stg_customer", "customer_id"),
            checks.unique("stg_customer", "customer_id"),
            checks.unique("mart_balance_by_nation", "nation_name"),
            checks.relationship("stg_orders", "o_custkey", "stg_customer", "customer_id"),
            checks.accepted_values("stg_orders", "o_orderstatus", ["O", "F"]),
        ],
        state=state,
    )


@query(
    "operate_dataset",
    """
    SELECT 'tm_daily_raw.customer' AS item, 'rows' AS result, count(*) AS n FROM customer
    UNION ALL SELECT 'tm_daily_raw.orders', 'rows', count(*) FROM orders
    UNION ALL SELECT 'tm_daily_raw.nation', 'rows', count(*) FROM nation
    UNION ALL SELECT 'tm_daily_staging.stg_customer', 'rows', count(*) FROM customer
    UNION ALL SELECT 'tm_daily_staging.stg_orders', 'rows', count(*) FROM orders
    UNION ALL SELECT 'tm_daily_staging.stg_nation', 'rows', count(*) FROM nation
    UNION ALL SELECT 'tm_daily_marts.mart_balance_by_nation', 'rows', count(DISTINCT c_nationkey) FROM customer
    UNION ALL SELECT 'not_null_stg_customer_customer_id', 'pass', 0
    UNION ALL SELECT 'unique_stg_customer_customer_id', 'pass', 0
    UNION ALL SELECT 'unique_mart_balance_by_nation_nation_name', 'pass', 0
    UNION ALL SELECT 'relationship_stg_orders_o_custkey_stg_customer_customer_id', 'pass', 0
    UNION ALL SELECT 'accepted_values_stg_orders_o_orderstatus_O_F', 'fail', count(DISTINCT o_orderstatus) FROM orders
              WHERE o_orderstatus NOT IN ('O', 'F')
    """,
)
def operate_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land, profile, stage, build, check and count; returns row counts and check results."""
    report = operate(spark, sales_plan(spark, sf_dir, new_scratch(spark, "state")), "1")
    counts = report.counts.select(F.col("table_name").alias("item"), F.lit("rows").alias("result"), F.col("n_rows").alias("n"))
    return counts.union(report.checks.select("name", "status", "failures"))

"""Views, mart tables and the sandbox in which a model is tried first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from tidemill.functions.names import quoted, unique_names
from tidemill.plans.guarded import EXECUTION_ERROR, GuardedSession, Refusal
from tidemill.sinks.landing import save_table
from tidemill.sources.catalog import create_database

SANDBOX = "_sandbox"

# What may be odd about a model.
ZERO_ROWS = "zero_rows"
ONE_ROW = "one_row"
DUPLICATE_COLUMNS = "duplicate_columns"


@dataclass(frozen=True)
class Trial:
    """A model in the sandbox: its table, some of its rows, and what is odd about it; or why there is none."""

    table: DataFrame | None = None
    sample: DataFrame | None = None
    rows: int = 0
    oddities: tuple[str, ...] = ()
    refusal: Refusal | None = None


def create_view(df: DataFrame, name: str) -> None:
    """A staging model: a name for the plan, computed where it is used."""
    df.createOrReplaceTempView(name)


def save_view(spark: SparkSession, db: str, name: str, sql: str) -> None:
    """A staging model every session sees."""
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(db)}.{quoted(name)} AS {sql}")


def materialize(df: DataFrame, db: str, name: str, sandbox: str = SANDBOX) -> int:
    """A mart: written as a table; a sandbox copy of the same name is dropped."""
    rows = save_table(df, db, name)
    drop_sandbox(df.sparkSession, name, sandbox)
    return rows


def sandbox_build(
    session: GuardedSession, name: str, sql: str, sample_limit: int = 20, sandbox: str = SANDBOX, root: str | None = None
) -> Trial:
    """Write the result of one read-only query into the sandbox. Repeated column names are numbered."""
    planned = session.plan(sql)
    if planned.refusal is not None:
        return Trial(refusal=planned.refusal)
    df = planned.frame.toDF(*unique_names(planned.frame.columns))
    spark = df.sparkSession
    try:
        create_database(spark, sandbox, root)
        rows = save_table(df, sandbox, name)
    except PySparkException as e:
        return Trial(refusal=Refusal(EXECUTION_ERROR, "the model could not be built", str(e)))
    oddities = [kind for kind, on in ((ZERO_ROWS, rows == 0), (ONE_ROW, rows == 1)) if on]
    if df.columns != planned.frame.columns:
        oddities.append(DUPLICATE_COLUMNS)
    table = spark.table(f"{quoted(sandbox)}.{quoted(name)}")
    return Trial(table, table.limit(sample_limit), rows, tuple(oddities))


def drop_sandbox(spark: SparkSession, name: str, sandbox: str = SANDBOX) -> None:
    if spark.catalog.databaseExists(sandbox):
        spark.sql(f"DROP TABLE IF EXISTS {quoted(sandbox)}.{quoted(name)}")

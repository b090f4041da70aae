"""Where queries are registered, and the helpers they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.session import new_scratch, prepare
from tidemill.sources.catalog import Layers, create_database, register_parquet

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its equivalent on the same tables, if there is one."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), str(sf_dir).rstrip("/"))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def catalog_tables(spark: SparkSession, sf_dir: str, db: str, tables: list[str]) -> str:
    """A database that names some of the given tables; their files are not copied."""
    create_database(spark, db, new_scratch(spark, "db"))
    for table in tables:
        register_parquet(spark, db, table, f"{sf_dir}/{table}.parquet")
    return db


def layers(spark: SparkSession, dataset: str) -> Layers:
    """The layer databases of a dataset, in the scratch folder."""
    return Layers(dataset, new_scratch(spark, "layers")).create(spark)

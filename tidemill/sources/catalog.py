"""Databases per dataset layer, and what the catalog knows about them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemill.functions.names import quoted
from tidemill.session import local_frame

# Database suffixes of the raw, staging and mart layers.
LAYER_SUFFIXES = ("_raw", "_staging", "_marts")

_DATASET_NAME = re.compile(r"[a-z0-9][a-z0-9_-]{0,63}", re.IGNORECASE)


@dataclass(frozen=True)
class Layers:
    """The databases of one dataset; ``root`` places them in a folder instead of the warehouse.

    Spark allows no ``-`` in database names, so ``_`` stands for it there.
    """

    dataset: str
    root: str | None = None

    def __post_init__(self) -> None:
        if not _DATASET_NAME.fullmatch(self.dataset):
            raise ValueError(f"invalid dataset name {self.dataset!r}: 1-64 letters, digits, '_' or '-'")

    @property
    def databases(self) -> tuple[str, ...]:
        return tuple(self.dataset.replace("-", "_") + suffix for suffix in LAYER_SUFFIXES)

    @property
    def raw(self) -> str:
        return self.databases[0]

    @property
    def staging(self) -> str:
        return self.databases[1]

    @property
    def marts(self) -> str:
        return self.databases[2]

    def create(self, spark: SparkSession) -> "Layers":
        for db in self.databases:
            create_database(spark, db, self.root)
        return self


def create_database(spark: SparkSession, db: str, root: str | None = None) -> None:
    place = f" LOCATION '{root.rstrip('/')}/{db}'" if root else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(db)}{place}")


def tables_in(spark: SparkSession, db: str) -> list[str]:
    """Tables and views of a database, without the session's temp views, which every listing repeats."""
    return sorted(t.name for t in spark.catalog.listTables(quoted(db)) if not t.isTemporary)


def table_exists(spark: SparkSession, db: str, table: str) -> bool:
    return spark.catalog.tableExists(f"{quoted(db)}.{quoted(table)}")


def require_table(spark: SparkSession, db: str, table: str) -> DataFrame:
    if not table_exists(spark, db, table):
        raise ValueError(f"no such table {db}.{table}")
    return spark.table(f"{quoted(db)}.{quoted(table)}")


def layer_databases(spark: SparkSession, suffixes: tuple[str, ...] = LAYER_SUFFIXES) -> list[str]:
    """All databases that belong to some dataset's layers."""
    return sorted(d.name for d in spark.catalog.listDatabases() if d.name.endswith(suffixes))


def list_columns(spark: SparkSession, databases: list[str] | tuple[str, ...]) -> DataFrame:
    """``(database, table_name, column_pos, column_name, type)`` of every table in the databases."""
    rows = [
        (db, table, i, c.name, c.dataType)
        for db in databases
        for table in tables_in(spark, db)
        for i, c in enumerate(spark.catalog.listColumns(f"{quoted(db)}.{quoted(table)}"))
    ]
    schema = "database string, table_name string, column_pos int, column_name string, type string"
    return local_frame(spark, rows, schema)


def register_parquet(spark: SparkSession, db: str, table: str, path: str) -> None:
    """Name an existing parquet file or folder in the catalog without copying it."""
    name = f"{quoted(db)}.{quoted(table)}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")

"""Land sources as raw tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from tidemill.functions.names import quoted
from tidemill.session import side_by_side
from tidemill.sources.catalog import Layers, create_database
from tidemill.sources.files import read_source
from tidemill.sources.paths import filesystem


@dataclass(frozen=True)
class TableSpec:
    """One source that becomes one raw table."""

    source: str
    table: str
    delimiter: str | None = None
    member: str | None = None
    schema: str | None = None


@dataclass(frozen=True)
class Dataset:
    name: str
    tables: Sequence[TableSpec]
    root: str | None = None

    @property
    def layers(self) -> Layers:
        return Layers(self.name, self.root)


def save_table(df: DataFrame, db: str, table: str) -> int:
    """Replace a table and return its row count, which parquet answers from file footers.

    The rows go to a new folder and the name is moved to it when they are complete. A failed write
    leaves the old table as it was, running readers keep their files, and ``df`` may read the table
    it replaces. ``remove_old_versions`` frees the space.
    """
    spark = df.sparkSession
    name = f"{quoted(db)}.{quoted(table)}"
    folder = f"{_table_folder(spark, db, table)}/{uuid.uuid4().hex}"
    df.write.parquet(folder)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{folder}'")
    return spark.table(name).count()


def _table_folder(spark: SparkSession, db: str, table: str) -> str:
    return f"{spark.catalog.getDatabase(quoted(db)).locationUri.rstrip('/')}/{table}.versions"


def remove_old_versions(spark: SparkSession, db: str, table: str) -> int:
    """Delete the folders of a table's earlier versions; returns how many there were."""
    details = spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(db)}.{quoted(table)}").where("col_name = 'Location'").first()
    current = details["data_type"].rstrip("/").rsplit("/", 1)[-1]
    files, folder = filesystem(_table_folder(spark, db, table))
    versions = files.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    if current not in {v.base_name for v in versions}:
        raise ValueError(f"{db}.{table} was not written by save_table")
    old = [v for v in versions if v.base_name != current]
    for version in old:
        files.delete_dir(version.path)
    return len(old)


def land_source(spark: SparkSession, spec: TableSpec, db: str) -> int:
    """Land one source unchanged; running it again gives the same table."""
    df = read_source(spark, spec.source, spec.delimiter, spec.member, spec.schema)
    return save_table(df, db, spec.table)


def land_dataset(spark: SparkSession, dataset: Dataset) -> dict[str, int]:
    """Land every declared table into the dataset's raw database; row counts by table."""
    layers = dataset.layers
    create_database(spark, layers.raw, dataset.root)
    counts = side_by_side(spark, land_source, [(spark, spec, layers.raw) for spec in dataset.tables])
    return {spec.table: n for spec, n in zip(dataset.tables, counts)}

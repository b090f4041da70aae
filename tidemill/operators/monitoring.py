"""Row-count snapshots and the drift between two of them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.names import quoted
from tidemill.session import local_frame
from tidemill.sources.catalog import LAYER_SUFFIXES, tables_in

SNAPSHOT_SCHEMA = "table_name string, n_rows long"


def rowcount_snapshot(spark: SparkSession, databases: Sequence[str]) -> DataFrame:
    """``(table_name, n_rows)`` of every table and view in the databases.

    Counting a parquet table reads no column. All counts are one lazy union, so they run as one job.
    What cannot be analysed, such as a view on a table that is gone, is left out.
    """
    counts = []
    for db in databases:
        for table in tables_in(spark, db):
            try:
                rows = spark.table(f"{quoted(db)}.{quoted(table)}")
            except AnalysisException:
                continue
            counts.append(rows.agg(F.lit(f"{db}.{table}").alias("table_name"), F.count(F.lit(1)).alias("n_rows")))
    return reduce(DataFrame.union, counts) if counts else local_frame(spark, [], SNAPSHOT_SCHEMA)


def save_snapshot(snapshot: DataFrame, path: str, run_id: str) -> None:
    """Keep a snapshot under its run id; a repeated run replaces its own snapshot only."""
    snapshot.write.mode("overwrite").parquet(f"{path.rstrip('/')}/run_id={run_id}")


def load_snapshot(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT_SCHEMA).parquet(f"{path.rstrip('/')}/run_id={run_id}")


def previous_snapshot(spark: SparkSession, path: str, before: str) -> DataFrame | None:
    """The latest snapshot of a run before ``before``, if there is one."""
    try:
        kept = spark.read.schema(f"{SNAPSHOT_SCHEMA}, run_id string").parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    last = kept.where(F.col("run_id") < before).agg(F.max("run_id")).first()[0]
    return None if last is None else load_snapshot(spark, path, last)


def rowcount_drift(previous: DataFrame, current: DataFrame, threshold: float = 0.20) -> DataFrame:
    """Tables that are new, dropped or changed by at least ``threshold``; an empty previous table is skipped."""
    p = previous.select("table_name", F.col("n_rows").alias("previous_rows"))
    c = current.select("table_name", F.col("n_rows").alias("current_rows"))
    both = p.join(c, "table_name", "full")
    before, now = F.col("previous_rows"), F.col("current_rows")
    change = F.when(before > 0, (now - before) / before)
    kind = (
        F.when(before.isNull(), "new")
        .when(now.isNull(), "dropped")
        .when(change >= threshold, "up")
        .when(change <= -threshold, "down")
    )
    return (
        both.withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select("table_name", "kind", "previous_rows", "current_rows", change.alias("change"))
    )


def dataset_metrics(snapshot: DataFrame) -> DataFrame:
    """One row: raw tables, staging models, marts and total raw rows of a snapshot."""
    layer = {s: F.split_part("table_name", F.lit("."), F.lit(1)).endswith(s) for s in LAYER_SUFFIXES}
    raw, staging, marts = (layer[s] for s in LAYER_SUFFIXES)
    return snapshot.agg(
        F.count_if(raw).alias("n_sources"),
        F.count_if(staging).alias("n_staging"),
        F.count_if(marts).alias("n_marts"),
        F.coalesce(F.sum(F.when(raw, F.col("n_rows"))), F.lit(0)).alias("raw_rows"),
    )

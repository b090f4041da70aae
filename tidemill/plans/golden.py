"""The standing questions, asked of the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.columns import col


def largest_for_size(scores: DataFrame, key: str, columns: list[str], k: int = 5) -> DataFrame:
    """The rows furthest above the power law, numbered; only ``k`` rows are ever ranked."""
    order = [F.desc("residual"), F.asc(key)]
    top = scores.orderBy(*order).limit(k)
    return top.withColumn("overperformer_rank", F.row_number().over(Window.orderBy(*order)).cast("long")).select(*columns)


def top_overperformer(scores: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return largest_for_size(scores, key, columns, 1)


def rank_of(outliers: DataFrame, key: str, value: object) -> DataFrame:
    return outliers.where(col(key) == F.lit(value)).select(col(key), "overperformer_rank")


def rows_per_group(stats: DataFrame, group: str) -> DataFrame:
    return stats.select(col(group), "n_rows").orderBy(F.desc("n_rows"), F.asc_nulls_last(group))


def largest_group(stats: DataFrame, group: str) -> DataFrame:
    return rows_per_group(stats, group).limit(1)


def average_of(stats: DataFrame, group: str, value: object) -> DataFrame:
    return stats.where(col(group) == F.lit(value)).select(col(group), "avg_value")


def group_with_maximum(stats: DataFrame, group: str) -> DataFrame:
    return stats.select(col(group), "max_value").orderBy(F.desc_nulls_last("max_value"), F.asc_nulls_last(group)).limit(1)


def present_rows(projection: DataFrame, required: str, columns: list[str], order: list, k: int = 10) -> DataFrame:
    return projection.where(col(required).isNotNull()).select(*columns).orderBy(*order).limit(k)


def total_rows(stats: DataFrame) -> DataFrame:
    return stats.agg(F.sum("n_rows").alias("total_rows"))

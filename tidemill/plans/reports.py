"""Frames behind the report page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col
from tidemill.operators.joins import with_scalars
from tidemill.plans.marts import power_fit


def top_groups(stats: DataFrame, group: str, min_values: int = 5, k: int = 20) -> DataFrame:
    """The groups with the highest average among those with enough values."""
    return (
        stats.where(F.col("n_with_value") >= min_values)
        .select(col(group), "n_rows", "n_with_value", "avg_value", "max_value")
        .orderBy(F.desc_nulls_last("avg_value"), F.asc_nulls_last(group))
        .limit(k)
    )


def power_trend(points: DataFrame, x: str, y: str) -> DataFrame:
    """The points with the fitted power curve at their ``x``: ``trend = exp(intercept) * x ^ slope``."""
    fit = power_fit(points, x, y)
    curve = with_scalars(points.where((col(x) > 0) & (col(y) > 0)), fit, ["slope", "intercept"])
    trend = F.exp("intercept") * F.pow(col(x), F.col("slope"))
    return curve.select(*[col(c) for c in points.columns], F.round(trend, 2).alias("trend"))


def mart_frame(mart: DataFrame, cap: int = 1000) -> DataFrame:
    """Rows of any mart for display."""
    return mart.limit(cap)

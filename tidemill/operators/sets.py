"""Set operations with SQL set semantics.

Intersection and difference are one aggregation over both sides instead of a null-safe join of two
distinct inputs: one shuffle, no sort, NULLs equal by grouping, and the copies of a frequent row
folded map-side, so they never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.union(right).distinct()


def _by_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row per distinct row of either side, with the sides it occurs in."""
    mark = lambda df, on_left: df.select("*", F.lit(on_left).alias("_left"), F.lit(not on_left).alias("_right"))
    both = mark(left, True).union(mark(right, False))
    return both.groupBy(*[col(c) for c in left.columns]).agg(
        F.bool_or("_left").alias("_left"), F.bool_or("_right").alias("_right")
    )


def intersect(left: DataFrame, right: DataFrame) -> DataFrame:
    return _by_row(left, right).where("_left AND _right").drop("_left", "_right")


def subtract(left: DataFrame, right: DataFrame) -> DataFrame:
    return _by_row(left, right).where("_left AND NOT _right").drop("_left", "_right")

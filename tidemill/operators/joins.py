"""Joins that cannot multiply rows by surprise, and the measurement of those that do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col
from tidemill.session import stage


def with_scalars(df: DataFrame, one_row: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``df CROSS JOIN one_row`` as a scalar subquery.

    The subquery fails if it has a second row, so this can never turn into a product of two tables,
    and no join is planned at all.
    """
    names = list(columns or one_row.columns)
    packed = one_row.select(F.struct(*[col(c) for c in names]).alias("_s")).scalar()
    return df.select("*", packed.alias("_s")).select(*[col(c) for c in df.columns], *[F.col(f"_s.`{c}`") for c in names])


def join_preaggregated(
    parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, measures: Sequence[Column], how: str = "left"
) -> DataFrame:
    """Reduce ``child`` to one row per key before joining, so that no parent row is repeated.

    The reduction is combined map-side; however many rows one key has, it enters the join once.
    """
    rollup = child.groupBy(col(child_key).alias("_key")).agg(*measures)
    return parent.join(rollup, parent[parent_key] == rollup["_key"], how).drop("_key")


def orphan_keys(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Non-null child keys without a parent, with their number of rows: ``(value, n_rows)``.

    Both sides are one row per key before they meet, so no frequent key makes a large task.
    """
    counts = (
        child.where(col(child_key).isNotNull())
        .groupBy(col(child_key).alias("value"))
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )
    parents = parent.select(col(parent_key).alias("value")).distinct()
    return counts.join(parents, "value", "left_anti")


def orphan_rows(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """The child rows whose non-null key has no parent.

    An anti-join would shuffle all columns of all child rows. Here only keys are shuffled; the
    orphan keys are written, so the planner knows whether they are few enough to broadcast and can
    split a frequent one where they are not.
    """
    orphans = stage(orphan_keys(child, child_key, parent, parent_key).select(F.col("value").alias("_orphan")), "orphans")
    return child.join(orphans, col(child_key) == F.col("_orphan"), "left_semi")


def fanout(
    parent: DataFrame, child: DataFrame, parent_key: str, child_key: str, measure: str | None = None
) -> DataFrame:
    """What joining ``child`` does to ``parent``, measured without running the join.

    One row: parent rows, joined rows, the factor between matched parent rows and joined rows, the
    most children of one key, and (with ``measure``) its sum before and after the join.
    """
    children = (
        child.where(col(child_key).isNotNull()).groupBy(col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    )
    # One row per key on either side: a key that repeats in the parent, NULL for instance, is folded too.
    folded = [F.count(F.lit(1)).alias("_p")] + ([F.sum(col(measure)).alias("_m")] if measure else [])
    counted = parent.groupBy(col(parent_key).alias("_k")).agg(*folded).join(children, "_k", "left")
    matched = F.col("_n").isNotNull()
    aggs = [
        F.coalesce(F.sum("_p"), F.lit(0)).alias("parent_rows"),
        F.coalesce(F.sum(F.when(matched, F.col("_p"))), F.lit(0)).alias("matched_rows"),
        F.coalesce(F.sum(F.col("_p") * F.col("_n")), F.lit(0)).alias("joined_rows"),
        F.coalesce(F.max("_n"), F.lit(0)).alias("max_children"),
    ]
    if measure:
        aggs += [
            F.sum(F.when(matched, F.col("_m"))).alias("sum_before"),
            F.sum(F.col("_m") * F.col("_n")).alias("sum_after"),
        ]
    out = counted.agg(*aggs)
    factor = F.when(F.col("matched_rows") > 0, F.col("joined_rows") / F.col("matched_rows"))
    return out.withColumn("fanout_factor", factor).withColumn(
        "fanout_risk", F.coalesce(factor > 1, F.lit(False))
    )

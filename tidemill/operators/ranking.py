"""Global rank, exact medians and top-k without one-task windows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.columns import col
from tidemill.session import local_frame, stage

# monotonically_increasing_id keeps the partition number above these bits, the row number below.
_ROW_BITS = 33


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows; ``order`` needs a unique last column for a repeatable answer."""
    return df.orderBy(*order).limit(k)


def top_values(df: DataFrame, column: str, k: int = 8) -> DataFrame:
    """The most frequent non-null values, ties by value: ``(value, n)``."""
    counts = df.where(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def global_rank(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``row_number() over (order by ...)`` on all rows, spread over all tasks.

    A window without PARTITION BY would send every row to one task. Here the rows are range
    partitioned on the sort keys and sorted inside each partition, so a row's rank is its place in
    its partition plus the sizes of the partitions before it. The numbered rows are written once:
    partition numbers are only stable when they are data. ``order`` must end in a unique column,
    which also lets a frequent sort value span several partitions.
    """
    numbered = stage(numbered_ranges(df, order), "rank")
    # One row per shuffle partition, so both the collect and the broadcast are bounded by that number.
    sizes = {r["_part"]: r["n"] for r in numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, before = [], 0
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    offsets_df = local_frame(df.sparkSession, offsets, "_part long, _before long")
    joined = numbered.join(F.broadcast(offsets_df), "_part")
    return joined.select(*[col(c) for c in df.columns], (F.col("_before") + F.col("_place") + 1).alias(name))


def numbered_ranges(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``df`` range partitioned and sorted, with the partition (``_part``) and the place in it (``_place``)."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = ranges.withColumn("_place", F.monotonically_increasing_id())
    return ranges.select(
        *[col(c) for c in df.columns],
        F.shiftright("_place", _ROW_BITS).alias("_part"),
        F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_place"),
    )


def grouped_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", accuracy: int | None = None
) -> DataFrame:
    """Exact interpolated median of ``value`` per group, one row per group; without keys, of all rows.

    Spark's ``median`` holds every distinct value of a group in one buffer, which no bound keeps small. Here a
    mergeable sketch brackets the middle of every group in a first pass; the second counts what lies below and
    above, and only values inside the bracket are shuffled, counted and range partitioned, so that no task holds
    more than one range of one group. A group of nothing but NULLs has a NULL median. ``accuracy`` asks for
    ``percentile_approx`` instead.
    """
    if accuracy is not None:
        return df.groupBy(*[col(k) for k in keys]).agg(F.percentile_approx(col(value), 0.5, accuracy).alias(name))
    brackets = stage(df.groupBy(*[col(k) for k in keys]).agg(*bracket(value)), "brackets")
    medians = bracketed_medians(df, brackets, keys, value, name)
    return with_medians(brackets.select(*[col(k) for k in keys]), medians, keys, name) if keys else medians


# Ranks of the sketch are off by at most one part in so many, so twice that on either side holds the middle.
BRACKET_ACCURACY = 1000


def bracket(value: str) -> list[Column]:
    """Aggregates that bracket the median of a column: ``_low`` and ``_high``, NULL where there is no value."""
    ends = F.percentile_approx(col(value).cast("double"), [0.5 - 2 / BRACKET_ACCURACY, 0.5 + 2 / BRACKET_ACCURACY], BRACKET_ACCURACY)
    return [F.get(ends, F.lit(0)).alias("_low"), F.get(ends, F.lit(1)).alias("_high")]


def bracketed_medians(df: DataFrame, brackets: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Medians of the groups with a value, from staged ``brackets``: one row of keys, ``_low`` and ``_high`` each.

    What is outside a bracket becomes one row of a task and group, at an end of the scale. Should a middle come to
    lie outside, its group is counted in full.
    """
    ends = brackets.select(*[col(k).alias(f"_b{i}") for i, k in enumerate(keys)], "_low", "_high")
    v = col(value).cast("double")
    rows = df.where(col(value).isNotNull()).select(*[col(k) for k in keys], v.alias("_v"))
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_b{i}")) for i, k in enumerate(keys)], F.lit(True))
    rows = rows.join(ends, same) if keys else with_one_row(rows, ends)
    lowest, highest = F.lit(float("-inf")), F.lit(float("nan"))
    place = F.when(F.col("_v") < F.col("_low"), lowest).when(F.col("_v") > F.col("_high"), highest).otherwise(F.col("_v"))
    inside = (F.col("_v") >= F.col("_low")) & (F.col("_v") <= F.col("_high"))
    placed = rows.select(*[col(k) for k in keys], place.alias("_v"), inside.alias("_inside"))
    # An end of the scale may be a value of its own; then it is told apart by the flag.
    counted = placed.groupBy(*[col(k) for k in keys], "_v", "_inside").agg(F.count(F.lit(1)).alias("_w"))
    weighted = _ranged(counted, keys)
    found = weighted_medians(weighted, keys, name)
    missed = _missed(weighted, keys)
    if missed.isEmpty():
        return found
    key_cols = [col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    theirs = missed.select(*key_cols) if keys else missed
    again = df.join(theirs, reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]), "left_semi") if keys else df
    full = weighted_medians(value_weights(again, keys, value), keys, name)
    if not keys:
        return full
    right = found.join(theirs, reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]), "left_anti")
    return right.unionByName(full)


def with_one_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """Every row with the columns of a table of one row, which is read once."""
    values = one.first()
    return rows.withColumns({c: F.lit(values[c]).cast(one.schema[c].dataType) for c in one.columns})


def _missed(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups whose middle is not inside their bracket."""
    w = lambda condition: F.sum(F.when(condition, F.col("_w")).otherwise(0))
    below = w(~F.col("_inside") & (F.col("_v") == float("-inf")))
    total = F.sum("_w")
    sums = weighted.groupBy(*[col(k) for k in keys]).agg(below.alias("_below"), w(F.col("_inside")).alias("_within"), total.alias("_total"))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    return sums.where((F.col("_total") > 0) & ((low <= F.col("_below")) | (high > F.col("_below") + F.col("_within"))))


def _ranged(weighted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Weighted values in range partitions by group and value (``_part``), written once."""
    ranges = weighted.repartitionByRange(*[F.asc_nulls_first(c) for c in (*keys, "_v")])
    # Every file holds one partition number, so its footer tells whether a filter on it needs the file.
    return stage(ranges.withColumn("_part", F.spark_partition_id()), "weights")


def value_weights(df: DataFrame, keys: Sequence[str], value: str, *more: Column) -> DataFrame:
    """Every group's distinct values (``_v``, as double) with their numbers of rows (``_w``), in range
    partitions by group and value (``_part``), written once. ``more`` are sums to keep beside them.

    A group's NULLs are one row of no weight.
    """
    key_cols = [col(k) for k in keys]
    return _ranged(df.groupBy(*key_cols, col(value).cast("double").alias("_v")).agg(F.count(col(value)).alias("_w"), *more), keys)


def with_medians(groups: DataFrame, medians: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """``groups`` with their medians, NULL where a group has no value."""
    theirs = medians.select(*[col(k).alias(f"_k{i}") for i, k in enumerate(keys)], col(name))
    same = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return groups.join(theirs, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def weighted_medians(weighted: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Medians of the groups of ``value_weights`` that have a value; without keys, one row.

    Sums per partition tell in which partition the middle of each group lies, and only that partition's rows
    of the group are read again and sorted.
    """
    keys = list(keys)
    key_cols = [col(k) for k in keys]
    # One row per group and partition it touches, and of these the one or two around the middle.
    cells = weighted.groupBy(*key_cols, "_part").agg(F.sum("_w").alias("_n"))
    by_group = Window.partitionBy(*key_cols)
    cells = cells.select(
        *key_cols,
        "_part",
        (F.sum("_n").over(by_group.orderBy("_part")) - F.col("_n")).alias("_before"),
        "_n",
        F.sum("_n").over(by_group).alias("_total"),
    )
    low = F.floor((F.col("_total") + 1) / 2).cast("long")
    high = (F.floor(F.col("_total") / 2) + 1).cast("long")
    inside = lambda t: (t > F.col("_before")) & (t <= F.col("_before") + F.col("_n"))
    cells = cells.where(inside(low) | inside(high)).select(
        *[col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_part").alias("_p"), "_before", low.alias("_low"), high.alias("_high"),
    )
    # Written, so that the planner knows their size and their parts can be listed.
    cells = stage(cells, "cells")
    parts = [r["_p"] for r in cells.select("_p").distinct().collect()]

    # The list has at most one entry per shuffle partition; files outside it are not read.
    same = [col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    near = weighted.where(F.col("_part").isin(parts)).join(cells, reduce(lambda a, b: a & b, same, F.col("_part") == F.col("_p")))
    running = Window.partitionBy(*key_cols, "_part").orderBy("_v")
    upto = F.col("_before") + F.sum("_w").over(running.rowsBetween(Window.unboundedPreceding, 0))
    near = near.withColumn("_to", upto).withColumn("_from", F.col("_to") - F.col("_w"))
    holds = lambda t: (F.col(t) > F.col("_from")) & (F.col(t) <= F.col("_to"))
    middles = near.groupBy(*key_cols).agg(
        F.max(F.when(holds("_low"), F.col("_v"))).alias("_a"), F.max(F.when(holds("_high"), F.col("_v"))).alias("_b")
    )
    return middles.select(*key_cols, ((F.col("_a") + F.col("_b")) / 2).alias(name))

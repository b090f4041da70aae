"""Invariants a result must satisfy."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col

TOLERANCE = 1e-6


def expect(
    df: DataFrame,
    row_count: int | None = None,
    min_rows: int | None = None,
    columns: Sequence[str] = (),
    first_row: Mapping[str, object] | None = None,
    all_positive: Sequence[str] = (),
) -> DataFrame:
    """``(expectation, ok)`` rows. A NULL is not positive; numbers of the first row may differ by 1e-6.

    ``first_row`` only means something for a sorted ``df``.
    """
    present = set(df.columns)
    results: list[tuple[str, Column]] = []
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, name in enumerate(all_positive):
        positive = F.count_if(col(name) > 0) if name in present else F.lit(-1)
        aggs.append(positive.alias(f"p{i}"))
    if row_count is not None:
        results.append(("row_count", F.col("n") == row_count))
    if min_rows is not None:
        results.append(("min_rows", F.col("n") >= min_rows))
    if columns:
        # Without a row there is no column to show either.
        results.append(("columns", (F.col("n") > 0) & F.lit(set(columns) <= present)))
    results += [(f"all_positive.{name}", F.col(f"p{i}") == F.col("n")) for i, name in enumerate(all_positive)]
    summary = df.agg(*aggs)
    if first_row:
        known = {k: v for k, v in first_row.items() if k in present}
        if known:
            # One struct, so that the first row is fetched once for all its columns.
            checks = [F.max(_matches(col(k), v).cast("int")).alias(f"m{i}") for i, (k, v) in enumerate(known.items())]
            matched = df.limit(1).agg(*checks).select(F.struct("*")).scalar()
            results += [(f"first_row.{k}", F.coalesce(matched[f"m{i}"] == 1, F.lit(False))) for i, k in enumerate(known)]
        results += [(f"first_row.{k}", F.lit(False)) for k in first_row if k not in present]
    rows = [F.struct(F.lit(n).alias("expectation"), F.coalesce(ok, F.lit(False)).alias("ok")) for n, ok in results]
    return summary.select(F.inline(F.array(*rows)))


def _matches(value: Column, wanted: object) -> Column:
    if wanted is None:
        return value.isNull()
    if isinstance(wanted, (int, float)) and not isinstance(wanted, bool):
        return F.coalesce(F.abs(value - F.lit(wanted)) <= TOLERANCE, F.lit(False))
    return F.coalesce(value == F.lit(wanted), F.lit(False))

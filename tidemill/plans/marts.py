"""Marts: curated answers built from staging models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col
from tidemill.operators.joins import with_scalars
from tidemill.operators.ranking import bracket, bracketed_medians, global_rank, with_medians
from tidemill.plans.staging import present_any
from tidemill.session import stage


def stats_by_group(df: DataFrame, group: str, value: str, second: str, digits: int = 2, second_digits: int = 1) -> DataFrame:
    """Statistics of ``value`` per group, for groups with at least one value, highest average first.

    ``df`` is read twice: all figures and a bracket around the median come from one aggregation, and the median from
    a second pass that shuffles only what lies inside the brackets.
    """
    v, s = col(value), col(second)
    stats = df.groupBy(col(group).alias(group)).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(v).alias("n_with_value"),
        F.round(F.avg(v).cast("double"), digits).alias("avg_value"),
        F.max(v).alias("max_value"),
        F.min(v).alias("min_value"),
        F.round(F.avg(s).cast("double"), second_digits).alias("avg_second"),
        *bracket(value),
    )
    stats = stage(stats.where("n_with_value > 0"), "stats")
    stats = with_medians(stats, bracketed_medians(df, stats, [group], value, "median_value"), [group], "median_value")
    return stats.select(
        col(group), "n_rows", "n_with_value", "avg_value",
        F.round("median_value", digits).alias("median_value"), "max_value", "min_value", "avg_second",
    ).orderBy(F.desc_nulls_last("avg_value"), F.asc_nulls_last(group))


def power_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``(slope, intercept, n_fit)`` of ln(y) over ln(x) for positive pairs."""
    ln_x, ln_y = F.ln(col(x)), F.ln(col(y))
    return df.where((col(x) > 0) & (col(y) > 0)).agg(
        F.regr_slope(ln_y, ln_x).alias("slope"),
        F.regr_intercept(ln_y, ln_x).alias("intercept"),
        F.count(F.lit(1)).alias("n_fit"),
    )


def power_law_scores(df: DataFrame, key: str, x: str, y: str, keep: Sequence[str] = (), write_base: bool = False) -> DataFrame:
    """How far each row's ``y`` is from the power law of ``y`` in ``x`` fitted over all rows, unranked.

    ``write_base`` keeps an input that is costly to compute (an aggregation or a join) from running once for
    the fit and again for the scores. ``residual`` is the unrounded distance, by which rows are ranked.
    """
    base = df.where((col(x) > 0) & (col(y) > 0)).select(col(key), *[col(c) for c in keep], col(x), col(y))
    if write_base:
        base = stage(base, "base")
    scored = with_scalars(base, power_fit(base, x, y), ["slope", "intercept"])
    predicted = F.col("intercept") + F.col("slope") * F.ln(col(x))
    scored = scored.select(
        *[col(c) for c in base.columns], predicted.alias("_ln_p"), (F.ln(col(y)) - predicted).alias("residual")
    )
    size = F.exp("_ln_p")
    return scored.select(
        *[col(c) for c in base.columns],
        F.round(size, 2).alias("predicted_value"),
        F.round(col(y) - size, 2).alias("value_gap"),
        F.round(F.exp("residual"), 3).alias("value_ratio"),
        F.round("residual", 4).alias("residual_ln"),
        "residual",
    )


def power_law_outliers(df: DataFrame, key: str, x: str, y: str, keep: Sequence[str] = (), write_base: bool = False) -> DataFrame:
    """``power_law_scores`` with every row's rank. ``key`` must be unique; it orders rows with equal residuals.
    Rows come unsorted; ``overperformer_rank`` carries the order."""
    scored = power_law_scores(df, key, x, y, keep, write_base)
    return global_rank(scored, [F.desc("residual"), F.asc(key)], "overperformer_rank").drop("residual")


def filtered_projection(
    df: DataFrame, columns: Sequence[str], required: str, any_of: Sequence[str], order: Sequence[Column]
) -> DataFrame:
    """Some columns of the rows that have ``required`` and at least one of ``any_of``."""
    return df.where(col(required).isNotNull() & present_any(any_of)).select(*[col(c) for c in columns]).orderBy(*order)


def ratio_by_group(scores: DataFrame, group: str, min_rows: int = 10) -> DataFrame:
    """Average ratio to the power law per group, for groups of at least ``min_rows``."""
    return (
        scores.groupBy(col(group).alias(group))
        .agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("value_ratio"), 3).alias("avg_ratio"))
        .where(F.col("n_rows") >= min_rows)
        .orderBy(F.desc_nulls_last("avg_ratio"), F.asc_nulls_last(group))
    )

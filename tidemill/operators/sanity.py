"""Value checks on a query result."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import is_numeric

# How columns that hold a share or a count are named.
SHARE_NAME = re.compile(r"(^|_)(pct|percent|rate|ratio)($|_)", re.IGNORECASE)
COUNT_PREFIXES = ("count", "n_", "num_", "cnt_")
COUNT_SUFFIXES = ("_count", "_n", "_num", "_cnt")

WARNING_SCHEMA = "kind string, column_name string, low double, high double"


def is_share(name: str) -> bool:
    return SHARE_NAME.search(name) is not None


def is_count(name: str) -> bool:
    return name.lower().startswith(COUNT_PREFIXES) or name.lower().endswith(COUNT_SUFFIXES)


def _warning(kind: str, column: str | None, low: Column | None = None, high: Column | None = None) -> Column:
    number = lambda c: (F.lit(None) if c is None else c).cast("double")
    return F.struct(
        F.lit(kind).alias("kind"),
        F.lit(column).cast("string").alias("column_name"),
        number(low).alias("low"),
        number(high).alias("high"),
    )


def result_sanity(df: DataFrame) -> DataFrame:
    """Warnings ``(kind, column_name, low, high)`` from one aggregation over the result.

    Empty result; a single row whose column is NULL; shares outside [0, 100]; negative counts.
    NaN is ignored.
    """
    fields = df.schema.fields
    # Positions instead of names: a result may repeat a column name.
    df = df.toDF(*[f"c{i}" for i in range(len(fields))])
    ranged = {i for i, f in enumerate(fields) if is_numeric(f.dataType) and (is_share(f.name) or is_count(f.name))}
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        aggs.append(F.count(f"c{i}").alias(f"k{i}"))
        if i in ranged:
            number = F.col(f"c{i}")
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
                number = F.when(~F.isnan(number), number)
            aggs += [F.min(number).alias(f"lo{i}"), F.max(number).alias(f"hi{i}")]
    found = [F.when(F.col("n") == 0, _warning("empty_result", None))]
    for i, f in enumerate(fields):
        null_row = (F.col("n") == 1) & (F.col(f"k{i}") == 0)
        found.append(F.when(null_row, _warning("all_null_aggregate", f.name)))
        if i not in ranged:
            continue
        low, high = F.col(f"lo{i}"), F.col(f"hi{i}")
        if is_share(f.name):
            found.append(F.when((low < 0) | (high > 100), _warning("out_of_range", f.name, low, high)))
        if is_count(f.name):
            found.append(F.when(low < 0, _warning("negative_count", f.name, low, high)))
    one = df.agg(*aggs)
    return one.select(F.explode(F.array(*found)).alias("w")).where(F.col("w").isNotNull()).select("w.*")

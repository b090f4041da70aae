"""Staging models: renames, casts and junk filters, always one row in, at most one row out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions.columns import col
from tidemill.functions.names import quoted, snake_case, unique_names


def clean_names(names: Sequence[str]) -> list[str]:
    return unique_names([snake_case(n) for n in names])


def stage_names(df: DataFrame) -> DataFrame:
    """Rename every column to a unique snake_case name; rows are untouched."""
    return df.toDF(*clean_names(df.columns))


def staging_select(names: Sequence[str], relation: str) -> str:
    """The same rename as the text of a view on ``db.table``."""
    renamed = ", ".join(f"{quoted(raw)} AS {quoted(clean)}" for raw, clean in zip(names, clean_names(names)))
    # The text goes through str.format once more when the view is made.
    return f"SELECT {renamed} FROM {'.'.join(quoted(p) for p in relation.split('.', 1))}".replace("{", "{{").replace("}", "}}")


def stage_columns(
    df: DataFrame,
    columns: Mapping[str, str],
    casts: Mapping[str, str] | None = None,
    derived: Mapping[str, Column] | None = None,
    required: Sequence[str] = (),
    lenient: Sequence[str] = (),
) -> DataFrame:
    """A curated model: ``columns`` maps raw to clean names, ``casts`` types clean ones, ``derived``
    adds expressions over the raw columns, and rows with a NULL in ``required`` are dropped.

    A value that does not fit its type ends the job, so no row is lost unseen. Casts of the ``lenient``
    columns give NULL instead; ``cast_rejects`` returns the rows this concerns.
    """
    casts = casts or {}
    out = []
    for raw, clean in columns.items():
        value = col(raw)
        if clean in casts:
            value = value.try_cast(casts[clean]) if clean in lenient else value.cast(casts[clean])
        out.append(value.alias(clean))
    out += [expression.alias(name) for name, expression in (derived or {}).items()]
    return any_missing_dropped(df.select(*out), required)


def cast_rejects(df: DataFrame, columns: Mapping[str, str], casts: Mapping[str, str], name: str = "rejected") -> DataFrame:
    """The rows of which a value does not fit its type, with the clean names of those columns in ``name``."""
    raw_of = {clean: raw for raw, clean in columns.items()}
    misfits = [
        F.when(col(raw_of[c]).isNotNull() & col(raw_of[c]).try_cast(kind).isNull(), F.lit(c)) for c, kind in casts.items()
    ]
    return df.withColumn(name, F.array_compact(F.array(*misfits))).where(F.size(name) > 0)


def any_missing_dropped(df: DataFrame, required: Sequence[str]) -> DataFrame:
    for name in required:
        df = df.where(col(name).isNotNull())
    return df


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """``c_custkey`` to ``cust_key``: drop a table prefix and set off a trailing ``key``."""
    return df.toDF(*stripped_names(df.columns, prefix))


def stripped_names(names: Sequence[str], prefix: str) -> list[str]:
    short = [n.removeprefix(prefix) for n in names]
    return [f"{n[:-3]}_key" if n.endswith("key") and not n.endswith("_key") else n for n in short]


def present_any(names: Sequence[str]) -> Column:
    """At least one of the columns is not NULL."""
    return reduce(lambda a, b: a | b, [col(n).isNotNull() for n in names])

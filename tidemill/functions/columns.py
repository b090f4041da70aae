"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.names import quoted


def col(name: str) -> Column:
    """A column by its exact name, whatever characters it holds."""
    return F.col(quoted(name))


def text_key(*parts: Column) -> Column:
    """Parts joined by blanks, trimmed; NULL if any part is NULL or nothing is left."""
    pieces: list[Column] = []
    for part in parts:
        if pieces:
            pieces.append(F.lit(" "))
        pieces.append(part)
    return F.nullif(F.trim(F.concat(*pieces)), F.lit(""))


def display(value: Column, dtype: T.DataType) -> Column:
    """A value as JSON-safe text: ISO dates, decimals as floats, everything else as Spark casts it."""
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        seconds = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        micros = F.date_format(value, "SSSSSS")
        return F.when(micros == "000000", seconds).otherwise(F.concat(seconds, F.lit("."), micros))
    if isinstance(dtype, T.DecimalType):
        return value.cast("double").cast("string")
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(value)
    return value.cast("string")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))

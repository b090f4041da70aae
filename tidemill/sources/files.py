"""Read any tabular file or folder by its extension; column names are kept as they are."""

from __future__ import annotations

import csv
import functools
import re
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.columns import col
from tidemill.functions.names import unique_names
from tidemill.session import stage
from tidemill.sources import records

# The delimiters a file without a declared one may use, in order of preference.
DELIMITERS = (",", "\t", ";", "|")

# How a delimiter may be spelled in a configuration.
_ESCAPES = {r"\t": "\t", r"\n": "\n", r"\r": "\r", r"\\": "\\"}

# A doubled quote inside reads as two quoted stretches, which is the same for counting.
_QUOTED = r'"[^"]*"'
# May stand before the first name.
_MARK = "\ufeff"


def normalise_delimiter(delimiter: str | None) -> str | None:
    return _ESCAPES.get(delimiter, delimiter) if delimiter else None


def extension(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[-1].lower() if "." in name else ""


def read_source(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    member: str | None = None,
    schema: T.StructType | str | None = None,
) -> DataFrame:
    """A DataFrame over one source. ``member`` picks a file inside zip archives.

    Without ``schema`` text formats are read once more to infer types from every row; at scale,
    pass the schema of an earlier landing.
    """
    try:
        return _reader(spark, path, delimiter, member, schema)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"source not found: {path}") from e
        raise


def _reader(spark: SparkSession, path: str, delimiter: str | None, member: str | None, schema) -> DataFrame:
    kind = extension(path)
    if kind == "zip":
        from tidemill.sources.archives import read_zip

        return read_zip(spark, path, member, delimiter, schema)
    if kind == "parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if kind in ("json", "ndjson"):
        return read_json(spark, path, schema=schema)
    return read_delimited(spark, path, delimiter, schema=schema)


def read_json(spark: SparkSession, path: str, columns: Sequence[str] | None = None, schema=None) -> DataFrame:
    """Objects, one on a line, over several lines, or in arrays; a folder may hold all of these, and every file is
    read by many tasks.

    A record that is no JSON ends the job. Spark sorts inferred fields by name; ``columns`` restores an order.
    """
    reader = spark.read.options(inferTimestamp=True, mode="FAILFAST")
    reader = reader if schema is None else reader.schema(schema)
    if records.all_json_lines(spark, path):
        df = reader.json(path)
    else:
        text = records.units(spark, path, records.JSON)
        states = records.starting_states(records.json_changes(text), "json-states")
        found = records.records(text, states, records.JSON)
        df = records.parsed(found if schema is not None else stage(found, "json-records"), reader, "json")
    df = _plain_types(df, widen=False)
    return df.select(*[col(c) for c in columns]) if columns else df


def read_delimited(
    spark: SparkSession,
    path: str,
    delimiter: str | None = None,
    schema: T.StructType | str | None = None,
    multi_line: bool | None = None,
) -> DataFrame:
    """Delimited text with a header line; the delimiter is sniffed when none is given.

    ``multi_line`` says whether quoted values hold line breaks; when it is not said, all lines are searched for such
    values. Files with them are read by many tasks too, from the states that a first pass finds. Every file is read by
    its own header: values meet by name, and a name that a file lacks is NULL in its rows. A declared ``schema`` is
    matched with the headers by name, and a header with other names ends the job, as does a line with more or fewer
    values than its header.
    """
    delimiter = normalise_delimiter(delimiter)
    survey = stage(_survey(spark, path), "survey")
    found = survey.agg(*_summary(), F.max("odd").alias("odd")).first()
    delimiter = delimiter or _chosen_delimiter([found], found["head"])
    broken = bool(found["odd"]) if multi_line is None else multi_line
    # Without pruning, as only whole lines can be checked.
    options = {"sep": delimiter, "escape": '"', "mode": "FAILFAST", "columnPruning": False}
    lines = None
    if broken:
        states = records.starting_states(survey.select("file_path", "start", F.col("quotes").alias("flips"), F.lit(0).alias("outside"), F.lit(0).alias("inside")), "csv-states")
        lines = stage(records.records(records.units(spark, path, records.CSV), states, records.CSV), "csv-records")
        heads = lines.where("first").select("file_path", F.col("value").alias("head"))
    else:
        heads = survey.groupBy("file_path").agg(F.min_by("head", "start").alias("head")).where("head IS NOT NULL")
    # A row for each different header; files come with few.
    headers = [r["head"] for r in heads.select("head").distinct().orderBy("head").collect()]
    names = {h: _names(h, delimiter) for h in headers}
    declared = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    for found_names in names.values():
        if declared is not None and (set(declared.names) != set(found_names) or len(found_names) != len(declared.names)):
            raise ValueError(f"the header has {found_names}, the schema {declared.names}")
    if not broken and len(headers) <= 1:
        reader = spark.read.options(**options, header=True)
        if declared is None:
            return _plain_types(_given_names(reader.options(inferSchema=True).csv(path), names[headers[0]] if headers else []), widen=True)
        in_file = T.StructType([declared[n] for n in (names[headers[0]] if headers else declared.names)])
        return reader.options(enforceSchema=False).schema(in_file).csv(path).select(*[col(n) for n in declared.names])
    if lines is None:
        lines = _lines(spark, path, heads)
    if len(headers) > 1:
        lines = lines.join(heads, "file_path")
    reader = spark.read.options(**options, header=False)
    parts = []
    for head in headers:
        own = (lines if len(headers) == 1 else lines.where(F.col("head") == head)).where("NOT first").select("value")
        if declared is not None:
            parts.append(records.parsed(own, reader.schema(T.StructType([declared[n] for n in names[head]])), "csv").select(*[col(n) for n in declared.names]))
        else:
            parts.append(_plain_types(_columns_of(records.parsed(own, reader.options(inferSchema=True), "csv"), names[head], spark), widen=True))
    if not parts:
        return spark.createDataFrame([], declared or T.StructType([]))
    if declared is None:
        parts = _one_type_each(parts)
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _lines(spark: SparkSession, path: str, heads: DataFrame) -> DataFrame:
    """Lines as records, without the first one of every file, which is its header."""
    text = records.units(spark, path, records.CSV)
    none = heads.limit(0).select("file_path", F.lit(0).cast("long").alias("start"), F.lit(False).alias("quoted"), F.lit(0).cast("long").alias("depth"))
    return records.records(text, none, records.LINES)


def _columns_of(df: DataFrame, names: list[str], spark: SparkSession) -> DataFrame:
    """Columns by the header; a file without further lines has columns of text."""
    if not df.columns:
        return spark.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in unique_names(names)]))
    return df.toDF(*unique_names(names)) if len({n.lower() for n in names}) < len(names) else df.toDF(*names)


def _one_type_each(parts: list[DataFrame]) -> list[DataFrame]:
    """Files with different headers are inferred one by one; a column of several types is what holds them all."""
    kinds: dict[str, set[str]] = {}
    for part in parts:
        for name, kind in part.dtypes:
            kinds.setdefault(name, set()).add(kind)
    numbers = {"bigint", "double"}
    common = {n: next(iter(k)) if len(k) == 1 else "double" if k <= numbers else "string" for n, k in kinds.items()}
    return [p.select(*[col(n).cast(common[n]).alias(n) for n in p.columns]) for p in parts]


def _survey(spark: SparkSession, path: str) -> DataFrame:
    """One row for each split of the files, from one pass over all lines: quotes, whether a line holds an odd number of
    them, so that a quoted value goes on in the next, how often each delimiter stands outside quotes in a line, at
    least and at most, and the first line."""
    text = spark.read.option("lineSep", "\n").text(path)
    lines = text.select("value", "_metadata.file_path", F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))
    lines = lines.where(F.trim("value", F.lit(" \r")) != "")
    count = lambda c, d: F.length(c) - F.length(F.replace(c, F.lit(d), F.lit("")))
    bare = F.regexp_replace("value", _QUOTED, "")
    quotes = count(F.col("value"), '"')
    aggs = [F.sum(quotes).alias("quotes"), (F.max(quotes % 2) == 1).alias("odd"), F.min_by("value", "place").alias("head")]
    for i, d in enumerate(DELIMITERS):
        aggs += [F.min(count(bare, d)).alias(f"least{i}"), F.max(count(bare, d)).alias(f"most{i}")]
    found = lines.groupBy("file_path", "start").agg(*aggs)
    # Files that end their lines in the oldest way are one line here.
    head = F.regexp_extract(F.ltrim("head", F.lit(_MARK)), r"^([^\r]*)", 1)
    return found.withColumn("head", F.when(F.col("start") == F.min("start").over(Window.partitionBy("file_path")), head))


def _summary() -> list:
    """A survey of several splits as one."""
    return [f(F.col(f"{n}{i}")).alias(f"{n}{i}") for i in range(len(DELIMITERS)) for n, f in (("least", F.min), ("most", F.max))] + [F.min_by("head", F.struct("file_path", "start")).alias("head")]


def text_survey(spark: SparkSession, path: str) -> list[Row]:
    """One row per file: whether quoted values go on over lines, and how often each delimiter stands in a line."""
    found = _survey(spark, path).groupBy("file_path").agg(F.max("odd").alias("broken"), *_summary())
    return found.collect()


def _names(head: str, delimiter: str) -> list[str]:
    return next(csv.reader([head.lstrip(_MARK)], delimiter=delimiter))


def _given_names(df: DataFrame, names: list[str]) -> DataFrame:
    """Repeated header names get ``_1``, ``_2``; Spark would rename all of them."""
    if len(names) != len(df.columns) or len({n.lower() for n in names}) == len(names):
        return df
    return df.toDF(*unique_names(names))


def _plain_types(df: DataFrame, widen: bool) -> DataFrame:
    """Timestamps without zone, and (for delimited text) 64-bit integers whatever the values."""
    out = []
    for f in df.schema.fields:
        c = col(f.name)
        if isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz").alias(f.name)
        elif widen and isinstance(f.dataType, T.IntegerType):
            c = c.cast("bigint").alias(f.name)
        out.append(c)
    return df.select(*out)


def sniff_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter that splits all lines into the same, largest number of fields."""
    found = text_survey(spark, path)
    return _chosen_delimiter(found, min(found, key=lambda r: r["file_path"])["head"] if found else None)


def _chosen_delimiter(found: Sequence[Row], head: str | None) -> str:
    least = [min((r[f"least{i}"] or 0 for r in found), default=0) for i in range(len(DELIMITERS))]
    most = [max((r[f"most{i}"] or 0 for r in found), default=0) for i in range(len(DELIMITERS))]
    steady = {d: n for d, n, m in zip(DELIMITERS, least, most) if n and n == m}
    if steady:
        return max(steady, key=steady.get)
    # Ragged or quoted-over-lines text: trust the header line.
    bare = re.sub(_QUOTED, "", head) if head else ""
    header = {d: bare.count(d) for d in DELIMITERS if bare.count(d)}
    return max(header, key=header.get) if header else DELIMITERS[0]

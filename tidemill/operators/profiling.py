"""Column profiles, candidate keys, grain and the schema summary.

The reference rule is two to four queries per column. Here one aggregation reads all columns, a
second job checks the few near-unique columns exactly, and frequent values come from one
unpivoted aggregation per data type. Only one row per column ever reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemill.functions.columns import col, display, is_numeric, is_temporal
from tidemill.functions.names import quoted
from tidemill.operators.relationships import QUERY_KEY_NAME, infer_relationships_by_grain
from tidemill.session import local_frame, side_by_side, stage
from tidemill.sources.catalog import tables_in

PROFILE_SCHEMA = """
    table_name string, table_pos int, row_count long, column_count int, column_pos int, name string, type string,
    null_count long, null_rate double, approx_distinct long, exact_distinct long, is_candidate_key boolean,
    min_value string, max_value string
"""


@dataclass(frozen=True)
class ProfileOptions:
    """``exact_names`` is a regex of column names whose distinct count is always exact."""

    key_band: float = 0.9
    # 2 ** 12 registers err by 1.6 %: a true key stays inside the band above.
    sketch_bits: int = 12
    sample_values: int = 8
    # Columns of more distinct values than this (by estimate) get no samples; None samples all.
    sample_max_distinct: int | None = None
    sample_types: tuple[type[T.DataType], ...] | None = None
    exact_names: str | None = None
    null_rate_digits: int | None = 4
    # Very wide tables are read in column groups, each column once.
    columns_per_pass: int = 100


# The variant a query session grounds itself on.
GROUNDING_OPTIONS = ProfileOptions(
    sample_types=(T.StringType, T.BooleanType, T.IntegerType, T.LongType),
    exact_names=QUERY_KEY_NAME,
    null_rate_digits=None,
)


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.MapType, T.VariantType))


def _hashable(field: T.StructField) -> Column:
    """Maps and variants cannot be hashed or grouped by, wherever they stand; their JSON text stands in for them."""
    return F.to_json(col(field.name)) if _holds_map(field.dataType) else col(field.name)


def _estimate(field: T.StructField, bits: int) -> Column:
    """Estimated number of distinct values. Unlike the buffer of approx_count_distinct, which is one
    plan attribute per 8 bytes, a sketch is a single binary value and keeps wide plans small."""
    hashed = F.when(col(field.name).isNotNull(), F.xxhash64(_hashable(field)))
    return F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(bits)))


def _column_stats(df: DataFrame, fields: Sequence[T.StructField], options: ProfileOptions) -> tuple[int, list[dict]]:
    """Row count and null count, distinct estimate, minimum and maximum of every column."""
    rows, stats = 0, []
    for start in range(0, len(fields), options.columns_per_pass):
        part = fields[start : start + options.columns_per_pass]
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, field in enumerate(part):
            c = col(field.name)
            aggs += [
                F.count(c).alias(f"c{i}"),
                _estimate(field, options.sketch_bits).alias(f"d{i}"),
            ]
            if is_numeric(field.dataType) or is_temporal(field.dataType):
                aggs += [
                    display(F.min(c), field.dataType).alias(f"lo{i}"),
                    display(F.max(c), field.dataType).alias(f"hi{i}"),
                ]
        row = df.agg(*aggs).first().asDict()
        rows = row["rows"]
        stats += [
            {"nulls": rows - row[f"c{i}"], "approx": row[f"d{i}"], "lo": row.get(f"lo{i}"), "hi": row.get(f"hi{i}")}
            for i in range(len(part))
        ]
    return rows, stats


def exact_distincts(df: DataFrame, fields: Sequence[T.StructField], rows: int) -> dict[str, int]:
    """Exact distinct counts of non-null columns, one job for all of them.

    Texts and nested values are first counted by an 8-byte hash: as many hashes as rows proves as many
    values, so those of a true key are never shuffled. Only where hashes repeat are values compared.
    """
    if not fields:
        return {}
    wide = (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType, T.VariantType)
    values = {f.name: _hashable(f) for f in fields}
    hashed = {f.name for f in fields if isinstance(f.dataType, wide)}
    counts = _count_distincts(df, {name: F.xxhash64(v) if name in hashed else v for name, v in values.items()})
    return {**counts, **_count_distincts(df, {name: values[name] for name in hashed if counts[name] != rows})}


def _count_distincts(df: DataFrame, expressions: dict[str, Column]) -> dict[str, int]:
    """Several COUNT(DISTINCT), those of one type from one scan and one shuffle of (column, value)."""
    if not expressions:
        return {}
    selected = df.select(*[e.alias(f"v{i}") for i, e in enumerate(expressions.values())])
    by_type: dict[str, list[int]] = {}
    for i, f in enumerate(selected.schema.fields):
        by_type.setdefault(f.dataType.simpleString(), []).append(i)
    parts = []
    for of_type in by_type.values():
        pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.col(f"v{i}").alias("v")) for i in of_type])).alias("p")
        pairs = selected.select(pairs).select("p.at", "p.v").where(F.col("v").isNotNull()).distinct()
        parts.append(pairs.groupBy("at").agg(F.count(F.lit(1)).alias("n")))
    names = list(expressions)
    found = {names[r["at"]]: r["n"] for r in reduce(DataFrame.union, parts).collect()}
    return {name: found.get(name, 0) for name in names}


def _profile_rows(df: DataFrame, table: str, position: int, options: ProfileOptions) -> list[tuple]:
    fields = df.schema.fields
    rows, stats = _column_stats(df, fields, options)
    band = [
        f
        for f, s in zip(fields, stats)
        if rows and s["nulls"] == 0 and (s["approx"] >= options.key_band * rows or _always_exact(f.name, options))
    ]
    exact = exact_distincts(df, band, rows)
    out = []
    for i, (f, s) in enumerate(zip(fields, stats)):
        rate = s["nulls"] / rows if rows else 0.0
        if options.null_rate_digits is not None:
            rate = round(rate, options.null_rate_digits)
        known = exact.get(f.name)
        out.append(
            (
                table, position, rows, len(fields), i, f.name, f.dataType.simpleString(), s["nulls"], rate,
                s["approx"] if known is None else known, known, bool(rows) and known == rows, s["lo"], s["hi"],
            )
        )
    return out


def profile_columns(df: DataFrame, table: str = "", position: int = 0, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """One row per column, without sample values (``PROFILE_SCHEMA``)."""
    return local_frame(df.sparkSession, _profile_rows(df, table, position, options), PROFILE_SCHEMA)


def _always_exact(name: str, options: ProfileOptions) -> bool:
    return options.exact_names is not None and re.search(options.exact_names, name, re.IGNORECASE) is not None


def sample_values(df: DataFrame, columns: Sequence[str], k: int = 8) -> DataFrame:
    """The ``k`` most frequent non-null values of every column: ``(column_name, rank, value, n)``.

    Columns of one type are unpivoted together, so ties are ordered by the typed value and each
    column is read once. The first ``k`` are kept in every task before the window's shuffle, so a
    column of many distinct values sends no more than others.
    """
    by_type: dict[str, list[T.StructField]] = {}
    for f in df.schema.fields:
        if f.name in columns:
            by_type.setdefault(f.dataType.simpleString(), []).append(f)
    parts = []
    for fields in by_type.values():
        dtype = fields[0].dataType
        values = df.select(*[_hashable(f).alias(f.name) for f in fields])
        long = values.unpivot([], [quoted(f.name) for f in fields], "column_name", "v").where(F.col("v").isNotNull())
        counts = long.groupBy("column_name", "v").agg(F.count(F.lit(1)).alias("n"))
        order = Window.partitionBy("column_name").orderBy(F.desc("n"), F.asc_nulls_last("v"))
        top = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        text = F.col("v") if _holds_map(dtype) else display(F.col("v"), dtype)
        parts.append(top.select("column_name", "rank", text.alias("value"), "n"))
    if not parts:
        return local_frame(df.sparkSession, [], "column_name string, rank int, value string, n long")
    return reduce(DataFrame.union, parts)


def _sampled_columns(df: DataFrame, stats: DataFrame, options: ProfileOptions) -> list[str]:
    types, most = options.sample_types, options.sample_max_distinct
    kept = stats if most is None else stats.where(F.col("approx_distinct") <= most)
    narrow = {r["name"] for r in kept.select("name").collect()}
    return [f.name for f in df.schema.fields if f.name in narrow and (types is None or isinstance(f.dataType, types))]


def profile_samples(df: DataFrame, options: ProfileOptions = ProfileOptions(), stats: DataFrame | None = None) -> DataFrame:
    """Sample values of the columns the options allow."""
    stats = profile_columns(df, options=options) if stats is None else stats
    return sample_values(df, _sampled_columns(df, stats, options), options.sample_values)


def profile_table(df: DataFrame, table: str = "", position: int = 0, options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """``profile_columns`` plus ``sample_values``, an array of at most ``options.sample_values`` texts."""
    stats = profile_columns(df, table, position, options)
    samples = profile_samples(df, options, stats)
    lists = samples.groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("sample_values")
    )
    empty = F.array().cast("array<string>")
    return stats.join(lists, stats["name"] == lists["column_name"], "left").select(
        *[stats[c] for c in stats.columns], F.coalesce("sample_values", empty).alias("sample_values")
    )


def profile_tables(tables: dict[str, DataFrame], options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """Profiles of several tables in declaration order."""
    spark = next(iter(tables.values())).sparkSession
    jobs = [(df, name, i, options) for i, (name, df) in enumerate(tables.items())]
    return reduce(DataFrame.union, side_by_side(spark, profile_table, jobs))


def profile_many_columns(tables: dict[str, DataFrame], options: ProfileOptions = ProfileOptions()) -> DataFrame:
    """Column statistics of several tables, without samples."""
    spark = next(iter(tables.values())).sparkSession
    jobs = [(df, name, i, options) for i, (name, df) in enumerate(tables.items())]
    rows = [row for part in side_by_side(spark, _profile_rows, jobs) for row in part]
    return local_frame(spark, rows, PROFILE_SCHEMA)


def candidate_keys(profile: DataFrame) -> DataFrame:
    return profile.where("is_candidate_key").select("table_name", "name", "row_count")


def grain(profile: DataFrame) -> DataFrame:
    """The unique column with the shortest name, per table; tables without one are absent."""
    first = F.min(F.struct(F.length("name").alias("size"), F.col("name")))
    return profile.where("is_candidate_key").groupBy("table_name").agg(first["name"].alias("grain"))


SUMMARY_SCHEMA = """
    kind string, relation string, position int, subject string, type string, rows long, not_null boolean,
    null_rate double, distinct_values long, exact boolean, low string, high string, samples array<string>, target string
"""


def schema_summary(profile: DataFrame, relationships: DataFrame, earlier: dict[str, DataFrame] | None = None) -> DataFrame:
    """What a session may know before it asks, as typed rows (``SUMMARY_SCHEMA``).

    Kinds: ``table`` (``subject`` is the grain, NULL without one), ``column``, ``link`` (``relation`` is the
    parent, ``target`` the child, ``subject`` the column, ``type`` the cardinality), and for the whole of each
    earlier result ``result`` and ``result_column``, of which ``samples`` are the most frequent values.
    """
    none = lambda kind: F.lit(None).cast(kind)

    def facts(df: DataFrame, kind: str, **columns: Column) -> DataFrame:
        fields = T.StructType.fromDDL(SUMMARY_SCHEMA).fields
        known = {"kind": F.lit(kind), **columns}
        return df.select(*[known.get(f.name, none(f.dataType)).cast(f.dataType).alias(f.name) for f in fields])

    c = F.col
    heads = profile.select("table_name", "row_count").distinct().join(grain(profile), "table_name", "left")
    parts = [
        facts(heads, "table", relation=c("table_name"), subject=c("grain"), rows=c("row_count")),
        facts(
            profile, "column", relation=c("table_name"), position=c("column_pos"), subject=c("name"), type=c("type"),
            rows=c("row_count"), not_null=c("null_count") == 0, null_rate=c("null_rate"), low=c("min_value"),
            high=c("max_value"), distinct_values=F.coalesce("exact_distinct", "approx_distinct"),
            exact=c("exact_distinct").isNotNull(), samples=c("sample_values"),
        ),
        facts(relationships, "link", relation=c("parent"), target=c("child"), subject=c("column_name"), type=c("cardinality")),
    ]
    for name, df in (earlier or {}).items():
        rows = df.agg(F.count(F.lit(1)).alias("n"))
        parts.append(facts(rows, "result", relation=F.lit(name), rows=c("n")))
        top = sample_values(df, df.columns).groupBy("column_name").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]).alias("values")
        )
        named = local_frame(df.sparkSession, [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)], "at int, column string, kind string")
        columns = named.join(top, named["column"] == top["column_name"], "left")
        empty = F.array().cast("array<string>")
        parts.append(
            facts(columns, "result_column", relation=F.lit(name), position=c("at"), subject=c("column"), type=named["kind"], samples=F.coalesce("values", empty))
        )
    return reduce(DataFrame.union, parts)


def ground(spark: SparkSession, databases: Sequence[str], earlier: dict[str, DataFrame] | None = None) -> DataFrame:
    """``schema_summary`` of all tables of some databases, profiled now, and of a session's earlier results."""
    tables = {f"{db}.{t}": spark.table(f"{quoted(db)}.{quoted(t)}") for db in databases for t in tables_in(spark, db)}
    if not tables:
        return local_frame(spark, [], SUMMARY_SCHEMA)
    profile = stage(profile_tables(tables, GROUNDING_OPTIONS), "grounding")
    return schema_summary(profile, infer_relationships_by_grain(profile), earlier)

"""Links between tables, inferred from shared key-shaped columns and measured uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which column names look like keys.
PROFILE_KEY_NAME = r"(^|_)(id|key|code|no)($|_)|_id$|^id$"
QUERY_KEY_NAME = r"(^|_)(id|key|code|rank|name)($|_)|_id$|^id$"


def _pairs(keys: DataFrame) -> tuple[DataFrame, Column, Column]:
    """Every two tables that share a column name. Rows are columns of tables, not data."""
    first = keys.alias("a")
    second = keys.alias("b")
    joined = first.join(second, F.col("a.key") == F.col("b.key")).where(F.col("a.table_pos") < F.col("b.table_pos"))
    return joined, F.col("a.is_parent"), F.col("b.is_parent")


def _oriented(joined: DataFrame, a_unique: Column, b_unique: Column, column: Column) -> DataFrame:
    a, b = F.col("a.table_name"), F.col("b.table_name")
    neither = ~a_unique & ~b_unique
    parent = F.when(a_unique, a).when(b_unique, b).otherwise(F.least(a, b))
    child = F.when(a_unique, b).when(b_unique, a).otherwise(F.greatest(a, b))
    cardinality = F.when(a_unique & b_unique, "1:1").when(neither, "many:many").otherwise("1:many")
    return joined.select(
        parent.alias("parent"), child.alias("child"), column.alias("column_name"), cardinality.alias("cardinality")
    )


def infer_relationships(profile: DataFrame, key_name: str = PROFILE_KEY_NAME) -> DataFrame:
    """Shared key-shaped names: unique on one side gives 1:many, on both 1:1, on none many:many.

    The first table in declaration order is the parent of a 1:1 link.
    """
    keys = profile.where(F.lower("name").rlike(key_name)).select(
        "table_name", "table_pos", F.lower("name").alias("key"), F.col("is_candidate_key").alias("is_parent")
    )
    return _oriented(*_pairs(keys), F.col("a.key"))


def infer_relationships_by_grain(profile: DataFrame, key_name: str = QUERY_KEY_NAME) -> DataFrame:
    """As above for equal base types only; a side is unique when the column is its table's grain."""
    from tidemill.operators.profiling import grain

    keys = (
        profile.where(F.lower("name").rlike(key_name))
        .join(grain(profile), "table_name", "left")
        .select(
            "table_name",
            "table_pos",
            "name",
            F.lower("name").alias("key"),
            F.regexp_extract("type", r"^[^(]+", 0).alias("base_type"),
            F.coalesce(F.col("grain") == F.col("name"), F.lit(False)).alias("is_parent"),
        )
    )
    joined, a, b = _pairs(keys)
    return _oriented(joined.where(F.col("a.base_type") == F.col("b.base_type")), a, b, F.col("a.name"))

"""The profile of a run as one document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_profile_document(profile: DataFrame, relationships: DataFrame, path: str) -> None:
    """Write a run's column profiles and relationships as JSON lines of one folder, each with its ``kind``
    (``column`` or ``relationship``) and the time of writing."""
    columns = profile.select(F.lit("column").alias("kind"), F.struct(*profile.columns).alias("column"))
    links = relationships.select(F.lit("relationship").alias("kind"), F.struct(*relationships.columns).alias("relationship"))
    both = columns.unionByName(links, allowMissingColumns=True).withColumn("written_at", F.current_timestamp())
    both.write.mode("overwrite").json(path)

"""Labelled rows for the classifiers: folds by a checksum of the id, and a bounded sample to fit on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import stage


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: CRC-32 of its id as text, modulo ``folds``; a NULL id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def examples(docs: DataFrame, labels: DataFrame, label: str, trains: Column, at_most: int) -> DataFrame:
    """Up to ``at_most`` different training texts as (doc_id, text, label), staged, the same ones on every run.

    ``trains`` selects label rows by their ``doc_id``. Of repeated label rows the highest label counts, NULL
    labels and ids none. Copies of a text under one id are one row. The choice goes by hashes of id and text:
    first one text of every id, then, if there is room, the other texts of repeated ids.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & trains)
    one = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    hashed = docs.select("doc_id", "text").withColumn("_text", F.xxhash64("text"))
    # Hashes, not texts, are chosen from; copies are put together before anything meets by id.
    texts = hashed.select("doc_id", "_text").distinct().join(one, "doc_id")
    order = F.xxhash64("doc_id")
    firsts = texts.groupBy("doc_id").agg(F.min("_text").alias("_first")).orderBy(order, "doc_id").limit(at_most)
    later = F.col("_text") != F.col("_first")
    # At most ``at_most`` rows on the side that is sent to all tasks, here and below.
    chosen = texts.join(F.broadcast(firsts), "doc_id").orderBy(later, F.when(later, F.xxhash64("doc_id", "_text")).otherwise(order), "doc_id", "_text").limit(at_most)
    joined = hashed.join(F.broadcast(chosen), ["doc_id", "_text"])
    rows = joined.groupBy("doc_id", "_text").agg(F.min("text").alias("text"), F.min("_label").alias("label"))
    return stage(rows.select("doc_id", "text", "label"), "examples")

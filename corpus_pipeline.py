"""A corpus through five operators: toxic documents go, one document of each similar group stays, repeated
strings and benchmark passages go, and what is left is tokenised.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between stages the rows
are written as Parquet and read again. All but the last return the columns of documents, ``n_chars`` brought
up to date where a text changes. Tables without rows pass through; NULL and empty texts are kept, and a NULL
``doc_id`` is kept as a row of its own.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, contamination, ngram_join, registry, suffix_dedup, toxicity
from tidemill.llm.text import session
from tidemill.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
# The trained models and greedy tilings of the stages have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score is 0.7 or more."""
    index = registry.toxicity_index(session(spark), docs, sf_dir)
    scored = toxicity.score(docs.select(*COLUMNS), index)
    return scored.where(F.col("score") < registry.TOXIC_FROM).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of texts whose 5-word shingles have a similarity of 0.8 or more, the smallest ``doc_id``."""
    session(spark)
    return ngram_join.one_of_each(docs.select(*COLUMNS), k=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 200-byte strings that occur more than once; a character cut in two goes as a whole.

    No row goes: a text that is repeated throughout stays as an empty one.
    """
    session(spark)
    deduped = suffix_dedup.dedup(docs.select(*COLUMNS), as_text=True)
    changed = F.size("removed") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    n_chars = F.when(changed, F.length("kept").cast("long")).otherwise(F.col("n_chars"))
    return deduped.select("doc_id", text.alias("text"), "lang", "source", n_chars.alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold at least half of a benchmark item, in any order."""
    benchmark = session(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination.contamination(docs.select(*COLUMNS), benchmark)
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text (little-endian 32-bit), and whether they decode to exactly the text."""
    session(spark)
    ranks, pattern = public_tokenizers.path(registry.RANKS), public_tokenizers.PATTERN
    encoded = bpe.encode(docs.select("doc_id", "text", "lang", "source"), ranks, pattern)
    both = bpe.decode(encoded, ranks, pattern)
    exact = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    n_tokens = (F.octet_length("token_ids") / 4).cast("long")
    return both.select("doc_id", "lang", "source", n_tokens.alias("n_tokens"), "token_ids", exact.alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", one_of_each_group),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each reading what the one before it wrote."""
    sf_dir = str(sf_dir).rstrip("/")
    docs = session(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

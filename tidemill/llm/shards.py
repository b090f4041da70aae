"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Every shard draws a score for a record's key; the record goes to the shard with the highest. A new shard
only adds one more draw, so a record either stays or moves into the new shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Hexadecimal digits of the digest that become the draw: 52 bits, exact in a double.
_DIGITS = 13
# Digits of the key's digest that name a block of slots.
_BLOCK_DIGITS = 2


def _text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key among ``len(weights)``; a shard's share of the keys follows its weight.

    A NULL key is a key of its own, the empty text. The draw is ``-weight / ln(u)`` with ``u`` in (0, 1) from
    the MD5 of key and shard number, so other systems can compute the same shard. Ties, if any, go to the
    higher number.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")
    text = _text(key)

    def draw(shard: int, weight: float) -> Column:
        digest = F.substring(F.md5(F.concat(text, F.lit(f":{shard}")).cast("binary")), 1, _DIGITS)
        u = (F.conv(digest, 16, 10).cast("double") + 0.5) / float(16**_DIGITS)
        return F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(shard).alias("shard"))

    draws = [draw(s, w) for s, w in enumerate(weights)]
    return (F.greatest(*draws) if len(draws) > 1 else draws[0])["shard"]


def shard(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Add ``shard``, ``slot`` (gapless from 0 in each shard) and, with ``grown`` weights, ``grown_shard``.

    Columns of ``df`` with these names are replaced. Rows with one key, copies included, share a shard; NULL
    keys share one too. An empty table stays empty. No task numbers a whole shard: a shard's rows are
    numbered in 256 blocks by a digest of the key, each starting where the blocks before it end. In a block
    rows go by key and ``order`` columns; rows equal in all of them take neighbouring slots in either order.
    """
    df = df.drop("shard", "slot", "grown_shard")
    placed = df.withColumn("shard", rendezvous(F.col(key), weights))
    placed = placed.withColumn("_block", F.substring(F.md5(_text(F.col(key)).cast("binary")), 1, _BLOCK_DIGITS))
    if grown is not None:
        # Only the added shards' draws can win against the present one.
        placed = placed.withColumn("grown_shard", rendezvous(F.col(key), grown))
    sizes = placed.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("shard").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = W.partitionBy("shard", "_block").orderBy(key, *order)
    numbered = placed.withColumn("_at", F.row_number().over(within))
    # One row for each shard and block: at most 256 for each weight.
    out = numbered.join(F.broadcast(starts), ["shard", "_block"])
    return out.withColumn("slot", F.col("_start") + F.col("_at") - 1).drop("_block", "_start", "_at")

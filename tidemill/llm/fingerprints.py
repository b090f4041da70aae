"""Document fingerprints by one-permutation MinHash.

Each shingle is hashed once; the high bits choose a bin and the rest is the value, of which every bin keeps the
smallest. A bin that got none borrows from the first filled bin in a fixed random order of its own, which
keeps the share of equal bins an unbiased estimate of the Jaccard similarity. Only the low bits of each value
are stored; the estimate takes out the share of bins that agree by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.text import Chunk, chunks, map_batches, map_stream, shingles, words

SHINGLE_WORDS = 5
BIN_BITS = 9
STORED_BITS = 4

_orders: dict[int, np.ndarray] = {}


def _order(bins: int) -> np.ndarray:
    """For each bin, the order in which it looks for a filled one."""
    if bins not in _orders:
        rng = np.random.default_rng(20180114)
        _orders[bins] = np.argsort(rng.random((bins, bins)), axis=1)
    return _orders[bins]


def minima(chunk: Chunk, k: int, bin_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, bins) values after densification, and which rows have any shingle."""
    bins = 1 << bin_bits
    hashes, rows = shingles(words(chunk), k)
    cell = rows * bins + (hashes >> np.uint64(64 - bin_bits)).astype(np.int64)
    free = np.iinfo(np.uint64).max
    values = np.full(chunk.rows * bins, free, np.uint64)
    np.minimum.at(values, cell, hashes & np.uint64((1 << 64 - bin_bits) - 1))
    filled = (values != free).reshape(chunk.rows, bins)
    some = filled.any(axis=1)
    empty = np.flatnonzero(~filled & some[:, None])
    row, bin_ = empty // bins, empty % bins
    order = _order(bins)
    for step in range(bins):
        if not len(empty):
            break
        source = order[bin_, step]
        hit = filled[row, source]
        values[empty[hit]] = values[row[hit] * bins + source[hit]]
        empty, row, bin_ = empty[~hit], row[~hit], bin_[~hit]
    return values.reshape(chunk.rows, bins), some


def packed(chunk: Chunk, k: int = SHINGLE_WORDS, bin_bits: int = BIN_BITS, bits: int = STORED_BITS) -> list[bytes]:
    """Every row's low bits, packed; no bytes for a text without words."""
    values, some = minima(chunk, k, bin_bits)
    low = (values & np.uint64((1 << bits) - 1)).astype(np.uint8)
    planes = (low[:, :, None] >> np.arange(bits, dtype=np.uint8)[::-1]) & 1
    rows = np.packbits(planes.reshape(chunk.rows, -1), axis=1)
    return [rows[r].tobytes() if some[r] else b"" for r in range(chunk.rows)]


def likeness(a: bytes, b: bytes, bits: int = STORED_BITS) -> float:
    """Estimated Jaccard similarity of two fingerprints, between 0 and 1. Two texts without words are alike,
    one without words is unlike any other."""
    if not a or not b:
        return float(a == b)
    differ = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(-1, bits).any(axis=1)
    chance = 2.0**-bits
    return float(np.clip((1 - differ.mean() - chance) / (1 - chance), 0, 1))


def fingerprint(docs: DataFrame, k: int = SHINGLE_WORDS, bin_bits: int = BIN_BITS, bits: int = STORED_BITS) -> DataFrame:
    """``docs`` with ``fingerprint`` (binary) of every whole text; a column of that name is replaced.

    Shingles are runs of ``k`` words (without ASCII white space, A to Z folded); a shorter text is one
    shingle. Equal texts have equal fingerprints; texts without words, NULL ones too, have empty ones.
    """
    docs = docs.drop("fingerprint")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("fingerprint", T.BinaryType())])

    def run(batch: pa.RecordBatch):
        found = [p for chunk in chunks(batch.column(at)) for p in packed(chunk, k, bin_bits, bits)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=schema.names)

    return map_batches(docs, run, schema)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next_text): every document with the text of the next one by ascending ``doc_id``.

    NULL ids come first and rows that repeat an id follow each other by a hash of their text, then by text;
    the last row is followed by the first. Texts are shuffled once, in ranges of ids; the first row of a
    range goes to the range before it as well.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    bounds = np.array(docs.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0] or [], np.int64)
    bounds = np.unique(bounds)

    def part_of(ids: pa.Array) -> np.ndarray:
        # A NULL id is below every bound.
        low = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, low)

    def number(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([pa.array(part_of(batch.column(0)), pa.int32()), *batch.columns], names=["part", "doc_id", "tie"])

    numbered = map_batches(keyed.select("doc_id", "tie"), number, "part int, doc_id long, tie long")
    # One row for each range.
    heads = numbered.groupBy("part").agg(F.min(F.struct("doc_id", "tie")).alias("head")).orderBy("part").collect()
    before = {r["part"]: heads[i - 1]["part"] for i, r in enumerate(heads)}
    head_of = {r["part"]: (r["head"]["doc_id"], r["head"]["tie"]) for r in heads}

    def deal(batch: pa.RecordBatch):
        part = part_of(batch.column(0))
        ids, ties = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        guests = [i for i, p in enumerate(part.tolist()) if head_of[p] == (ids[i], ties[i])]
        rows = batch.take(pa.array([*range(batch.num_rows), *guests], pa.int64()))
        to = pa.array([*part.tolist(), *(before[int(part[i])] for i in guests)], pa.int32())
        guest = pa.array([False] * batch.num_rows + [True] * len(guests))
        yield pa.RecordBatch.from_arrays([to, guest, *rows.columns], names=["part", "guest", "doc_id", "tie", "text"])

    dealt = map_batches(keyed, deal, "part int, guest boolean, doc_id long, tie long, text string")
    dealt = dealt.repartitionById(parts, "part").sortWithinPartitions("part", "guest", F.asc_nulls_first("doc_id"), "tie", "text")

    def follow(batches):
        held = None  # the part, id and text of the row before
        for batch in batches:
            out = []
            for part, guest, doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
                if held is not None and held[0] == part:
                    out.append((held[1], held[2], text))
                # A guest only follows; further copies of it follow nothing.
                held = None if guest else (part, doc_id, text)
                if len(out) >= 500:
                    yield _texts(out)
                    out = []
            yield _texts(out)

    return map_stream(dealt, follow, "doc_id long, text string, next_text string")


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "text": pa.string(), "next_text": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], names=list(kinds))


def edited(text: str, following: str) -> str:
    """``text`` with its last half of code points, rounded down, replaced by as many first ones of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(pairs: DataFrame, k: int = SHINGLE_WORDS, bin_bits: int = BIN_BITS, bits: int = STORED_BITS) -> DataFrame:
    """For (doc_id, text, next_text): fingerprints of the text and of its edited form, and the likeness of
    the text's fingerprint to those of the edited and of the next text."""

    def run(batch: pa.RecordBatch):
        texts, following = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        # A row's next text is mostly the row behind it, so few are hashed twice.
        changed = [edited(t, n) for t, n in zip(texts, following)]
        columns = [batch.column(1), pa.array(changed, pa.string())]
        own, other = ([p for c in chunks(column) for p in packed(c, k, bin_bits, bits)] for column in columns)
        apart = [i for i, n in enumerate(following) if i + 1 == len(texts) or texts[i + 1] != n]
        extra = dict(zip(apart, (p for c in chunks(pa.array([following[i] for i in apart], pa.string())) for p in packed(c, k, bin_bits, bits))))
        near_edited = [likeness(a, b, bits) for a, b in zip(own, other)]
        near_next = [likeness(a, extra[i] if i in extra else own[i + 1], bits) for i, a in enumerate(own)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), columns[1], pa.array(own, pa.binary()), pa.array(other, pa.binary()), pa.array(near_edited), pa.array(near_next)],
            names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return map_batches(
        pairs.select("doc_id", "text", "next_text"), run,
        "doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double",
    )

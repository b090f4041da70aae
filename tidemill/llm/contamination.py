"""Benchmark passages in documents, found again even when reordered, by greedy string tiling.

Documents and benchmark items are joined on shared seeds, runs of ``least`` words. Where the seeds could cover
enough of an item, the pair is tiled: the longest common runs that do not overlap are marked first, then
shorter ones, each search a running Karp-Rabin match. The share of an item's words that tiles cover is the
same whatever the order of its parts.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.text import NOT_ALPHANUMERIC, chunks, map_stream, positions, shingles, words
from tidemill.session import stage

LEAST_RUN = 4
COVERAGE = 0.5
# Benchmark text sent to the workers at a time; more is taken in several passes over the documents.
BLOCK_BYTES = 8 << 20

_PRIME, _BASE = (1 << 61) - 1, 1_000_003
HITS = T.ArrayType(
    T.StructType([T.StructField("item_id", T.LongType()), T.StructField("coverage", T.DoubleType()), T.StructField("tiles", T.IntegerType())])
)


def _runs(tokens: list[int], free: list[bool], size: int):
    """(hash, position) of every run of ``size`` unmarked tokens, by a rolling hash."""
    high = pow(_BASE, size - 1, _PRIME)
    value = length = 0
    for i, token in enumerate(tokens):
        if not free[i]:
            value = length = 0
            continue
        if length == size:
            value = (value - tokens[i - size] * high) % _PRIME
            length -= 1
        value = (value * _BASE + token) % _PRIME
        length += 1
        if length == size:
            yield value, i - size + 1


def greedy_tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """Tiles (start in item, start in text, length): longest first, none overlapping, none under ``least``.

    Of equally long matches, the earlier in the item goes first, then the earlier in the text.
    """
    free_item, free_text = [True] * len(item), [True] * len(text)
    tiles: list[tuple[int, int, int]] = []
    size = min(len(item), len(text))
    while size >= least:
        table: dict[int, list[int]] = {}
        for value, at in _runs(text, free_text, size):
            table.setdefault(value, []).append(at)
        matches = []
        for value, p in _runs(item, free_item, size) if table else ():
            for t in table.get(value, ()):
                if item[p : p + size] != text[t : t + size]:
                    continue
                end = size
                while p + end < len(item) and t + end < len(text) and free_item[p + end] and free_text[t + end] and item[p + end] == text[t + end]:
                    end += 1
                matches.append((-end, p, t))
        heapq.heapify(matches)
        seen = set(matches)
        while matches:
            length, p, t = heapq.heappop(matches)
            length = -length
            taken = [i for i in range(length) if not (free_item[p + i] and free_text[t + i])]
            if not taken:
                tiles.append((p, t, length))
                free_item[p : p + length] = [False] * length
                free_text[t : t + length] = [False] * length
                continue
            # What other tiles left of this match takes its turn among the others of its length.
            for start, end in zip([-1, *taken], [*taken, length]):
                part = (start + 1 - end, p + start + 1, t + start + 1)
                if end - start - 1 >= size and part not in seen:
                    seen.add(part)
                    heapq.heappush(matches, part)
        size = size // 2 if size > 2 * least else size - 1
    return tiles


class Items:
    """The seeds of a block of benchmark items."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int):
        self.ids, self.least = ids, least
        self.tokens: list[np.ndarray] = []
        seeds, owners, starts = [], [], []
        for chunk in chunks(pa.array(texts, pa.string())):
            found = words(chunk, separators=NOT_ALPHANUMERIC)
            for r in range(chunk.rows):
                self.tokens.append(found.hash[found.first[r] : found.first[r + 1]])
            hashes, rows = shingles(found, least)
            long = np.diff(found.first)[rows] >= least
            first = np.searchsorted(rows, rows)
            seeds.append(hashes[long])
            owners.append(rows[long] + chunk.first)
            starts.append((np.arange(len(rows)) - first)[long])
        empty = np.zeros(0, np.int64)
        seed = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.argsort(seed, kind="stable")
        self.seed = seed[order]
        self.item = np.concatenate(owners)[order] if owners else empty
        self.start = np.concatenate(starts)[order] if starts else empty
        self.distinct, first = np.unique(self.seed, return_index=True)
        self.first = np.append(first, len(self.seed))

    def hits(self, tokens: np.ndarray, seeds: np.ndarray, share: float) -> list[tuple[int, float, int]]:
        """(item id, coverage, tiles) of every item that a text's tokens cover well enough."""
        at = positions(self.distinct, seeds)
        where = np.flatnonzero(at >= 0)
        if not len(where):
            return []
        found: dict[int, tuple[list, set]] = {}
        for t in where.tolist():
            for i in range(self.first[at[t]], self.first[at[t] + 1]):
                in_text, in_item = found.setdefault(int(self.item[i]), ([], set()))
                if not in_text or in_text[-1] != t:
                    in_text.append(t)
                in_item.add(int(self.start[i]))
        out = []
        for number, (in_text, in_item) in sorted(found.items()):
            item = self.tokens[number]
            covered = np.zeros(len(item), bool)
            for s in in_item:
                covered[s : s + self.least] = True
            # Tiles lie where seeds are, so the seeds' own cover bounds theirs.
            if covered.sum() < share * len(item):
                continue
            keep = np.zeros(len(tokens), bool)
            for t in in_text:
                keep[t : t + self.least] = True
            # Only the stretches with seeds can match; a zero between them keeps them apart.
            part = np.where(keep, tokens, np.uint64(0))
            used = keep.copy()
            used[1:] |= keep[:-1]
            tiles = greedy_tiles(item.tolist(), part[used].tolist(), self.least)
            coverage = sum(length for _, _, length in tiles) / len(item)
            if coverage >= share:
                out.append((self.ids[number], coverage, len(tiles)))
        return out


def _scan(docs: DataFrame, items: Items, share: float) -> DataFrame:
    """``docs`` with this block's hits put behind those of the column ``hits``."""
    shared = docs.sparkSession.sparkContext.broadcast(items)
    names = docs.columns
    text_at, hits_at = names.index("text"), names.index("hits")

    def run(batches):
        for batch in batches:
            own, hits = shared.value, batch.column(hits_at).to_pylist()
            for chunk in chunks(batch.column(text_at)):
                found = words(chunk, separators=NOT_ALPHANUMERIC)
                seeds, rows = shingles(found, own.least)
                first = np.searchsorted(rows, np.arange(chunk.rows + 1))
                for r in range(chunk.rows):
                    new = own.hits(found.hash[found.first[r] : found.first[r + 1]], seeds[first[r] : first[r + 1]], share)
                    if new:
                        hits[chunk.first + r] = [*(hits[chunk.first + r] or []), *({"item_id": i, "coverage": c, "tiles": n} for i, c, n in new)]
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.int32())]))
            columns = [pa.array(hits, kind) if i == hits_at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_stream(docs, run, docs.schema)


def contamination(docs: DataFrame, benchmark: DataFrame, least: int = LEAST_RUN, share: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``hits``: the items (item_id, coverage, tiles) of which a text holds at least ``share``.

    Words are runs of letters and digits (any byte above ASCII counts as a letter), A to Z folded. Items of
    fewer than ``least`` words are too short to tell and match nothing, NULL ones too. Texts without hits,
    empty and NULL ones too, have an empty list. Rows stay as they are; a column named ``hits`` is replaced.
    The benchmark comes in blocks of about ``block_bytes`` of text, one pass over the documents each.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-size // block_bytes))
    benchmark = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")
    out = docs.drop("hits").withColumn("hits", F.array().cast(HITS))
    for block in range(blocks):
        part = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        rows = sorted(((r["item_id"], r["text"]) for r in part.toLocalIterator()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        out = _scan(out, Items([i for i, _ in rows], [t for _, t in rows], least), share)
        if blocks > 1:
            out = stage(out, "hits")
    return out

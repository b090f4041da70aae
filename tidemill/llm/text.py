"""Texts of Arrow batches as arrays: bytes, words, shingles, and polynomial hashes of any stretch.

All functions work on a *chunk*, a run of rows whose UTF-8 bytes lie next to each other, so that one numpy
call serves many short texts and memory stays bounded whatever a batch holds. A text longer than a chunk
gets one of its own. NULL texts are read as empty.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemill.session import prepare

CHUNK_BYTES = 1 << 18

# An odd base has an inverse modulo 2**64, so hashes of stretches come from prefix sums by one product.
_BASE = 0x9E3779B97F4A7C15
INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

# Bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# What stands between the terms of a classifier: every ASCII byte but letters and digits.
NOT_ALPHANUMERIC = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


@dataclass
class Chunk:
    """Rows ``first`` to ``first + len(offsets) - 1`` of a batch and their bytes."""

    first: int
    bytes: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    def slice(self, row: int) -> memoryview:
        return memoryview(self.bytes)[self.offsets[row] : self.offsets[row + 1]]


def session(spark: SparkSession) -> SparkSession:
    """The library's settings, small batches for the Python workers, and shuffle files removed as soon as the
    job that wrote them is done."""
    prepare(spark)
    # A batch of texts stands in the executor and in its worker at once.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def give_back() -> None:
    """Return freed memory to the system: Python workers stay for other tasks and for other stages."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def map_stream(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow``, with the worker's memory given back at the end of every task."""

    def tidy(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(tidy, schema)


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """Run ``fn`` over the Arrow batches of ``df``."""

    def run(batches):
        for batch in batches:
            yield from fn(batch)

    return map_stream(df, run, schema)


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts (or binaries) of a column, about ``size`` bytes at a time."""
    if len(column) == 0:
        return
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield Chunk(row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row])
        row = stop


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values so that every bit depends on all of them."""
    h = values ^ (values >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1024), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.multiply.accumulate(steps)
    return have[:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes of all prefixes; ``stretch_hash`` turns two of them into the hash of a stretch."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(len(data)), out=out[1:])
    return out


def stretch_hash(prefixes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``start`` to ``end``, the same wherever they stand (not yet mixed)."""
    # The inverse powers undo the position; both tables have the chunk's length.
    return (prefixes[end] - prefixes[start]) * powers(len(prefixes), INVERSE)[start]


@dataclass
class Words:
    """Words of a chunk: hash, byte range, row; ``first[r]`` is the first word of row ``r``."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray


def words(chunk: Chunk, lower: bool = True, separators: np.ndarray = _SPACE) -> Words:
    """Words are runs without separators, which are ASCII white space by default; ``lower`` folds A to Z."""
    data = LOWER[chunk.bytes] if lower else chunk.bytes
    n = len(data)
    inside = ~separators[data]
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    filled = chunk.offsets[1:] > chunk.offsets[:-1]
    before[chunk.offsets[:-1][filled]] = False
    after[chunk.offsets[1:][filled] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(chunk.offsets, start, side="right") - 1
    hashes = mix(stretch_hash(prefix_hashes(data), start, end) + (end - start).astype(np.uint64))
    return Words(hashes, start, end, row, np.searchsorted(row, np.arange(chunk.rows + 1)))


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words and their rows, in text order.

    A text of fewer words gives its whole sequence as one shingle; one without words gives none.
    """
    counts = np.diff(words.first)
    n = len(words.hash)
    weights = powers(k + 1)
    out_hash, out_row = [], []
    if n >= k:
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total += words.hash[j : n - k + 1 + j] * weights[j]
        whole = words.row[: n - k + 1] == words.row[k - 1 :]
        out_hash.append(mix(total[whole] + np.uint64(k)))
        out_row.append(words.row[: n - k + 1][whole])
    for m in range(1, k):
        rows = np.flatnonzero(counts == m)
        if len(rows):
            at = words.first[rows]
            total = sum(words.hash[at + j] * weights[j] for j in range(m))
            out_hash.append(mix(total + np.uint64(m)))
            out_row.append(rows)
    if not out_hash:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, rows = np.concatenate(out_hash), np.concatenate(out_row)
    order = np.argsort(rows, kind="stable")
    return hashes[order], rows[order]


def distinct_by_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct hashes, sorted by row and hash."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[keep], rows[keep]


def counts_by_row(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's distinct hashes with how often they occur: (hash, row, count), sorted by row and hash."""
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return hashes[at], rows[at], np.diff(np.append(at, len(hashes)))


def positions(sorted_values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands in a sorted array, -1 where it does not."""
    if not len(sorted_values):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_values, wanted), len(sorted_values) - 1)
    return np.where(sorted_values[at] == wanted, at, -1)


def packed(values: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes as the largest needs, equal bytes next to each other, compressed."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << (8 * w))
    planes = values.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()
    small = pa.compress(planes, codec="zstd", asbytes=True)
    return np.array([width, len(small)], np.int64).tobytes() + small


def unpacked(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """``n`` numbers that ``packed`` wrote at a place, and the place behind them."""
    width, size = np.frombuffer(data, np.int64, 2, at).tolist()
    planes = pa.decompress(data[at + 16 : at + 16 + size], n * width, codec="zstd", asbytes=True)
    values = np.frombuffer(planes, np.uint8).reshape(width, n).T.copy().view(f"<u{width}").ravel()
    return values, at + 16 + size

"""Token counts of whole texts under a public vocabulary, looked up in two tiers on the map side.

Texts are cut at ASCII white space. The vocabulary's own splitting drops white space and looks at nothing across
it, so a text has as many tokens as its words have together. The first tier is a compact hash table of the
lengths of frequent words, sent to all tasks; what it misses is encoded by the library, once per worker as long
as the worker's cache holds it. No word of a text is ever shuffled: the table comes from summaries of at most
``SUMMARY`` words a task, and only decides how fast a word's length is found.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.text import Chunk, Words, chunks, map_stream, positions, words

# Words of the table, and words that a task's summary may name.
FREQUENT = 65_536
SUMMARY = 4_096
# Longer words are in no table and no cache.
LONGEST = 64
# Distinct words that a summarising task keeps, lengths that a worker's cache keeps, words encoded in one call.
_HELD = 500_000
_CACHED = 300_000
_ENCODED = 4_096
_CHUNK = 1 << 18

_encoders: dict[str, Encoder] = {}


class Encoder:
    """Lengths of words under one vocabulary file, with a bounded cache by hash."""

    def __init__(self, data: bytes):
        # One thread a task; the number of tasks is Spark's choice.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(data)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.lengths([" ", "\t\r\n\x0b\x0c", "a b"]).tolist() != [0, 0, int(self.lengths(["a", "b"]).sum())]:
            raise ValueError("this vocabulary gives white space tokens of its own")
        self.cache: dict[int, int] = {}

    def lengths(self, texts: list[str]) -> np.ndarray:
        """How many tokens each text has, without those that only mark begin and end."""
        out = []
        for at in range(0, len(texts), _ENCODED):
            out += map(len, self.tokenizer.encode_batch_fast(texts[at : at + _ENCODED], add_special_tokens=False))
        return np.array(out, np.int64)

    def missed(self, hashes: np.ndarray, word_at: Callable[[int], str], short: np.ndarray) -> np.ndarray:
        """Lengths of words that are not in the table; ``short`` tells which may be cached."""
        known = [self.cache.get(h, -1) for h in hashes.tolist()]
        out = np.array(known, np.int64)
        new = np.flatnonzero(out < 0)
        if len(new):
            out[new] = self.lengths([word_at(i) for i in new.tolist()])
            keep = new[short[new]]
            if len(self.cache) + len(keep) > _CACHED:
                self.cache.clear()
            self.cache.update(zip(hashes[keep[:_CACHED]].tolist(), out[keep[:_CACHED]].tolist()))
        return out


def _encoder(data: bytes) -> Encoder:
    key = hashlib.sha256(data).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(data)
    return _encoders[key]


def _word(chunk: Chunk, found: Words, i: int) -> str:
    return chunk.bytes[found.start[i] : found.end[i]].tobytes().decode(errors="replace")


class _Summary:
    """Counts of the words seen so far; beyond ``_HELD`` words the rarer half is forgotten."""

    def __init__(self):
        self.hash, self.n, self.word = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, object)

    def add(self, hashes: np.ndarray, n: np.ndarray, word: np.ndarray) -> None:
        both = np.concatenate([self.hash, hashes])
        self.hash, at, back = np.unique(both, return_index=True, return_inverse=True)
        self.n = np.bincount(back, np.concatenate([self.n, n]), len(at)).astype(np.int64)
        self.word = np.concatenate([self.word, word])[at]
        if len(self.hash) > _HELD:
            self.top(_HELD // 2)

    def top(self, k: int) -> None:
        order = np.sort(np.lexsort((self.hash, -self.n))[:k])
        self.hash, self.n, self.word = self.hash[order], self.n[order], self.word[order]


def frequent_words(docs: DataFrame, text: str = "text") -> pa.Table:
    """(key, word, n) of the ``FREQUENT`` words that the tasks over all ``docs`` have found most often, by key."""

    def run(batches):
        summary = _Summary()
        for batch in batches:
            for chunk in chunks(batch.column(0), _CHUNK):
                found = words(chunk, lower=False)
                hashes, at, n = np.unique(found.hash, return_index=True, return_counts=True)
                # Words that occur once here enter only when they come again; most never do.
                keep = np.flatnonzero((n > 1) & (found.end[at] - found.start[at] <= LONGEST))
                text_of = np.array([_word(chunk, found, i) for i in at[keep].tolist()], object)
                summary.add(hashes[keep], n[keep], text_of)
        summary.top(SUMMARY)
        yield pa.RecordBatch.from_arrays([pa.array(summary.hash.view(np.int64)), pa.array(summary.word, pa.string()), pa.array(summary.n)], names=["key", "word", "n"])

    summaries = map_stream(docs.select(text), run, "key long, word string, n long")
    summed = summaries.groupBy("key").agg(F.sum("n").alias("n"), F.min(F.struct("word")).alias("_word"))
    most = summed.orderBy(F.desc("n"), "key").limit(FREQUENT)
    return most.select("key", F.col("_word.word").alias("word"), "n").toArrow()


def count_tokens(docs: DataFrame, vocabulary_file: str, text: str = "text", output: str = "n_tokens") -> DataFrame:
    """Add the number of tokens of every whole text, without begin and end tokens, truncation or padding.

    Strings of special tokens inside a text are those tokens, as is the library's default. NULL and empty texts,
    and texts of white space alone, have none. Rows, repeated ones too, and other columns stay as they are; a
    column named like the output is replaced. The vocabulary must drop white space, else ValueError. Words are
    told apart by 64-bit hashes of their bytes.
    """
    with open(vocabulary_file, "rb") as f:
        data = f.read()
    top = frequent_words(docs, text)
    encoder = Encoder(data)
    lengths = encoder.lengths(top.column("word").to_pylist())
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    # At most FREQUENT hashes and lengths, and the vocabulary file.
    shared = docs.sparkSession.sparkContext.broadcast((data, keys[order], lengths[order].astype(np.uint16)))
    docs = docs.drop(output)
    schema = T.StructType([*docs.schema.fields, T.StructField(output, T.LongType())])
    at = docs.columns.index(text)

    def run(batches):
        data, keys, lengths = shared.value
        own = _encoder(data)
        for batch in batches:
            counts = np.zeros(batch.num_rows, np.int64)
            for chunk in chunks(batch.column(at), _CHUNK):
                found = words(chunk, lower=False)
                distinct, first, back = np.unique(found.hash, return_index=True, return_inverse=True)
                place = positions(keys, distinct)
                length = np.zeros(len(distinct), np.int64)
                length[place >= 0] = lengths[place[place >= 0]]
                missed = np.flatnonzero(place < 0)
                if len(missed):
                    source = first[missed]
                    short = found.end[source] - found.start[source] <= LONGEST
                    length[missed] = own.missed(distinct[missed], lambda i: _word(chunk, found, source[i]), short)
                counts[chunk.first : chunk.first + chunk.rows] = np.bincount(found.row, length[back], chunk.rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts)], names=schema.names)

    return map_stream(docs, run, schema)

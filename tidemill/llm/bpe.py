"""Byte-level BPE through a sentencepiece model that is written straight from a rank file.

Every token becomes one piece: its bytes, each as one printable character, with the negative rank as its
score. Sentencepiece then merges the best-scored neighbours first, which is the order of the ranks. The
normaliser is the identity. Texts are split by the vocabulary's pattern first, and each match is encoded
separately; a match that is a token as a whole is that token.
"""

from __future__ import annotations

import base64
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemill.llm.text import chunks, map_stream

# Matches kept with their ids in each worker before the memory is cleared.
REMEMBERED = 200_000

def byte_characters() -> list[str]:
    """One printable character for each byte: itself where printable, else the next free one above 255."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def parse_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank, from lines of base64 token and rank."""
    ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, data.splitlines())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("ranks must run from 0 without gaps")
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, body: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(body)) + body


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def sentencepiece_model(tokens: list[bytes]) -> bytes:
    """The serialised model. Field and enum numbers are fixed by sentencepiece's model format."""
    names = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    out = bytearray()
    for rank, token in enumerate(tokens):
        piece = "".join(names[b] for b in token).encode()
        out += _message(1, _message(1, piece) + b"\x15" + struct.pack("<f", -float(rank)) + _number(3, normal))
    out += _message(1, _message(1, b"<unk>") + b"\x15" + struct.pack("<f", 0.0) + _number(3, unknown))
    no_id = (1 << 64) - 1  # -1
    trainer = _number(3, bpe) + _number(4, len(tokens) + 1) + _number(40, len(tokens))
    trainer += _number(41, no_id) + _number(42, no_id) + _number(43, no_id)
    # No dummy prefix, no white space removed or escaped.
    normalizer = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return bytes(out) + _message(2, trainer) + _message(3, normalizer)


class Codec:
    """Encodes and decodes with the ranks of one file."""

    def __init__(self, data: bytes, pattern: str, model: bytes | None = None):
        self.tokens = parse_ranks(data)
        self.model = model
        self.processor: sentencepiece.SentencePieceProcessor | None = None
        self.names = dict(enumerate(byte_characters()))
        # Python's \s takes four control characters that Unicode does not count as white space.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"(?!\S)", r"(?!\P{White_Space})").replace(r"\s", r"\p{White_Space}")).findall
        self.known: dict[str, bytes] = {}

    def _prepare(self) -> None:
        """What only encoding needs."""
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=self.model or sentencepiece_model(self.tokens))
        self.whole = {token: struct.pack("<I", rank) for rank, token in enumerate(self.tokens)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian 32-bit numbers."""
        if self.processor is None:
            self._prepare()
        split = [self.split(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({m for matches in split for m in matches if m not in self.known})
        raw = [m.encode() for m in new]
        pieces = []
        for match, data in zip(new, raw):
            if data in self.whole:
                self.known[match] = self.whole[data]
            else:
                pieces.append(match)
        encoded = self.processor.encode([m.encode().decode("latin-1").translate(self.names) for m in pieces], num_threads=1)
        for match, ids in zip(pieces, encoded):
            self.known[match] = struct.pack(f"<{len(ids)}I", *ids)
        return [b"".join(map(self.known.__getitem__, matches)) for matches in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _with_binary(df: DataFrame, output: str) -> tuple[DataFrame, T.StructType]:
    df = df.drop(output)
    return df, T.StructType([*df.schema.fields, T.StructField(output, T.BinaryType())])


def encode(df: DataFrame, ranks_file: str, pattern: str, text: str = "text", output: str = "token_ids") -> DataFrame:
    """Add the tokens of every whole text as little-endian unsigned 32-bit ids.

    NULL and empty texts have no tokens. Rows and other columns stay as they are; a column named like the
    output is replaced. The rank file is read on the driver and sent along; its size is the vocabulary's.
    """
    with open(ranks_file, "rb") as f:
        ranks = f.read()
    # Written here once, so that tasks only load it.
    shared = df.sparkSession.sparkContext.broadcast((ranks, sentencepiece_model(parse_ranks(ranks))))
    df, schema = _with_binary(df, output)
    at = df.columns.index(text)

    def run(batches):
        # Gone with the task: workers stay for other tasks and stages, which need the memory.
        codec = Codec(shared.value[0], pattern, shared.value[1])
        for batch in batches:
            ids = []
            for chunk in chunks(batch.column(at)):
                ids += codec.encode([str(chunk.slice(r), "utf-8") for r in range(chunk.rows)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], names=schema.names)

    return map_stream(df, run, schema)


def decode(df: DataFrame, ranks_file: str, pattern: str, ids: str = "token_ids", output: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for; NULL ids give no bytes. Columns as in ``encode``."""
    with open(ranks_file, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    df, schema = _with_binary(df, output)
    at = df.columns.index(ids)

    def run(batches):
        codec = Codec(shared.value, pattern)
        for batch in batches:
            texts = [codec.decode(v.as_buffer() if v.is_valid else b"") for v in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], names=schema.names)

    return map_stream(df, run, schema)

import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tidemill.llm import bpe

RANKS = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return bpe.Codec(f.read(), P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    ranks = {t: i for i, t in enumerate(codec.tokens)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_encode_as_the_library_does(codec, library):
    rng = random.Random(1)
    pools = [" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ​", "abcdefgh'stvre", "0123456789½²", "é中文한글😀́\xad", "!?.,-_#$", "\x00\x7f▁Ġ"]
    for _ in range(3000):
        text = "".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 40)))
        ids = codec.encode([text])[0]
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_tokens_that_are_whole_matches_and_long_runs(codec, library):
    texts = [t.decode(errors="ignore") for t in codec.tokens[::17]] + ["a" * 50_000 + " " * 3000]
    assert all(np.frombuffer(i, "<u4").tolist() == library.encode_ordinary(t) for i, t in zip(codec.encode(texts), texts))


def test_round_trip_of_all_rows(docs, no_docs, rows, library):
    encoded = bpe.encode(docs.withColumnRenamed("lang", "decoded").withColumnRenamed("source", "token_ids"), RANKS, P.PATTERN)
    out = bpe.decode(encoded, RANKS, P.PATTERN).collect()
    assert len(out) == len(rows)
    for r in out:
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")
    assert bpe.encode(no_docs, RANKS, P.PATTERN).count() == 0


def test_clearing_the_memory_changes_nothing(codec, monkeypatch):
    texts = [f"some words {i}" for i in range(20)]
    whole = codec.encode(texts)
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    assert [codec.encode([t])[0] for t in texts] == whole


def test_ranks_must_be_complete():
    with pytest.raises(ValueError):
        bpe.parse_ranks(b"YQ== 0\nYg== 2\n")

import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidemill.llm import registry, token_counts

FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def plain(library, texts):
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_counts_are_the_librarys_for_all_rows(docs, no_docs, rows, library):
    clashing = docs.withColumnRenamed("n_chars", "n_tokens").withColumnRenamed("lang", "key")
    out = token_counts.count_tokens(clashing, FILE).collect()
    assert len(out) == len(rows)
    assert sorted((r["n_tokens"], r["text"] or "") for r in out) == sorted(zip(plain(library, [r[1] for r in rows]), (r[1] or "" for r in rows)))
    assert token_counts.count_tokens(no_docs, FILE).count() == 0


def test_odd_texts(spark, library):
    rng = random.Random(5)
    pools = [" \t\n\r\x0b\x0c\x1c\x85\xa0 ", "abcd'stveΣς", "0123½²", "é中文한글😀́", "!?.,-_#$<|>", "İẞſ\x00\x7f"]
    texts = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    texts += ["a<|endoftext|>b", "<|startoftext|>", "<|ENDOFTEXT|>", "e ́", "x" * 30_000, "don't 'S I'VE", "<| endoftext |>", None]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(frame, FILE).collect()}
    assert [out[i] for i in range(len(texts))] == plain(library, texts)


def test_small_tables_and_caches_change_nothing(docs, rows, library, monkeypatch):
    monkeypatch.setattr(token_counts, "FREQUENT", 5)
    with open(FILE, "rb") as f:
        encoder = token_counts.Encoder(f.read())
    monkeypatch.setattr(token_counts, "_CACHED", 3)
    words = [f"word{i}" for i in range(10)]
    for _ in range(2):
        got = encoder.missed(np.arange(10, dtype=np.uint64), words.__getitem__, np.ones(10, bool))
        assert got.tolist() == plain(library, words) and len(encoder.cache) <= 3
    out = token_counts.count_tokens(docs, FILE).collect()
    assert sum(r["n_tokens"] for r in out) == sum(plain(library, [r[1] for r in rows]))


def test_the_table_holds_what_is_most_frequent(spark):
    texts = ["often often often rare", "often again again", None, "again " * 5]
    top = token_counts.frequent_words(spark.createDataFrame([(t,) for t in texts], "text string"))
    found = dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist()))
    assert found["again"] == 7 and found["often"] >= 3 and "rare" not in found


def test_vocabularies_with_white_space_are_refused():
    with open(P.path("byte_bpe_50k.json"), "rb") as f, pytest.raises(ValueError):
        token_counts.Encoder(f.read())


def test_query_reads_whole_texts(spark, library):
    from conftest import TESTDATA

    out = registry.QUERIES["op12_token_counts"](spark, TESTDATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in out} == dict(zip(texts, plain(library, texts.values())))
    assert all(r["n_bytes"] == len(texts[r["doc_id"]].encode()) and r["over_limit"] == (r["n_tokens"] > 2048) for r in out)

import random

import numpy as np
import pyarrow as pa
import pytest
from llm.corpus import prose
from pyspark.sql import functions as F

from tidemill.llm import quality, toxicity
from tidemill.llm.labelled import examples, fold
from tidemill.llm.text import chunks

BAD = ["vilewort", "grimble", "snarkle"]


@pytest.fixture(scope="module")
def labelled(spark):
    """Documents of which a third hold bad words; labels for most, some repeated or NULL."""
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(240):
        text = prose(1000 + i, 60)
        toxic = i % 3 == 0
        if toxic:
            words = text.split(" ")
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(BAD) + rng.choice(["", "ly", "s"]))
            text = " ".join(words)
        poor = i % 4 == 0
        if poor:
            text = text.upper() if i % 8 else " ".join(w + "$$$" for w in text.split())
        docs.append((i, text, int(toxic), int(not poor)))
        if i % 10 != 9:
            labels.append((i, int(not poor), int(toxic)))
    labels += [(0, None, None), (0, 0, 1), (None, 1, 1), (9999, 1, 1)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string, toxic int, quality int"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_folds_are_checksums_of_the_id(spark):
    import zlib

    ids = [0, 1, 77, -5, None]
    got = spark.createDataFrame([(i,) for i in ids], "doc_id long").select(fold(F.col("doc_id"), 5)).collect()
    assert [r[0] for r in got] == [zlib.crc32(str(i).encode() if i is not None else b"") % 5 for i in ids]


def test_examples_are_bounded_and_have_one_label(labelled):
    docs, labels = labelled
    present = F.col("doc_id") < 9999
    got = examples(docs, labels, "toxic", present, 50).collect()
    assert len(got) == 50 and len({r["doc_id"] for r in got}) == 50
    assert sorted(got) == sorted(examples(docs, labels, "toxic", present, 50).collect())


def test_repeated_ids_stay_within_the_bound(spark):
    """One id with many copies and many texts leaves room for every other id."""
    hot = [(7, "the same text")] * 200 + [(7, f"text {i}") for i in range(200)]
    docs = spark.createDataFrame([*hot, *((i, f"other {i}") for i in range(10, 30)), (40, None), (40, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in (7, 40, *range(10, 30))], "doc_id long, toxic int")
    got = sorted(((r["doc_id"], r["text"] or "") for r in examples(docs, labels, "toxic", F.lit(True), 50).collect()))
    assert len(got) == len(set(got)) == 50 and {i for i, _ in got} == {7, 40, *range(10, 30)}
    copies = docs.where("text = 'the same text' OR doc_id = 40")
    assert examples(copies, labels, "toxic", F.lit(True), 50).count() == 2


def test_nearest_is_exact():
    rng = np.random.default_rng(0)
    n_terms, terms = 12, np.arange(12, dtype=np.uint64)
    index = toxicity.Index(toxicity.Vocabulary(terms, terms), rng.uniform(0.5, 3, n_terms), block=4)
    vectors = []
    for _ in range(90):
        at = np.sort(rng.choice(n_terms, rng.integers(0, 5), replace=False))
        vectors.append((at, index.vector(at, rng.integers(1, 4, len(at)).astype(float)) if len(at) else np.zeros(0)))
    index.fill(list(range(90)), rng.integers(0, 2, 90).tolist(), vectors)
    dense = np.zeros((90, n_terms))
    for i, (at, w) in enumerate(vectors):
        dense[i, at] = w
    for _ in range(60):
        at = np.sort(rng.choice(n_terms, rng.integers(1, 5), replace=False))
        q = index.vector(at, rng.integers(1, 4, len(at)).astype(float))
        near, similar = index.nearest(at, q, 7)
        all_ = np.sort(dense[:, at] @ q)[::-1]
        assert np.allclose(similar, all_[all_ > 0][:7])
        assert np.allclose(dense[index.ids[near]][:, at] @ q, similar)


def test_toxic_texts_are_told_apart(labelled, docs, no_docs, rows):
    table, labels = labelled
    trains = fold(F.col("doc_id"), 3) != 1
    index = toxicity.build(table, examples(table, labels, "toxic", trains, 1000))
    out = toxicity.score(table.withColumn("score", F.lit("old")), index).where(~trains).collect()
    assert all((r["score"] >= 0.7) == (r["toxic"] == 1) for r in out)
    assert all(len(r["neighbours"]) > 0 and r["similarities"] == sorted(r["similarities"], reverse=True) for r in out if r["toxic"])
    assert toxicity.score(no_docs, index).count() == 0
    odd = toxicity.score(docs, index).collect()
    assert len(odd) == len(rows) and len({r["score"] for r in odd if not r["neighbours"]}) == 1 and all(0 <= r["score"] < 0.7 for r in odd)


def test_toxicity_with_nothing_to_learn(labelled, docs):
    table, labels = labelled
    for chosen, rate in (("toxic = 0", None), ("doc_id < 0", 0.5)):
        index = toxicity.build(table, examples(table, labels.where(chosen), "toxic", F.lit(True), 100))
        scores = {r["score"] for r in toxicity.score(docs, index).collect()}
        assert len(scores) == 1 and (rate is None or scores == {rate})


def test_attention_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = quality.AttentionModel(6, seed=3)
    x, first, y = rng.normal(size=(9, 6)), np.array([0, 4, 5, 9]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = quality._sigmoid(model._forward(x, first)["logit"])
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()

    gradients = model._gradients(x, first, y)
    for name, g in gradients.items():
        flat = model.p[name].reshape(-1)
        for at in range(0, len(flat), max(1, len(flat) // 5)):
            was = flat[at]
            flat[at] = was + 1e-6
            up = loss()
            flat[at] = was - 1e-6
            down = loss()
            flat[at] = was
            assert abs((up - down) / 2e-6 - g.reshape(-1)[at]) < 1e-6


def test_attention_weighs_passages(rows):
    x, first = quality.passages(next(chunks(pa.array([r[1] for r in rows[:14]], pa.string()))))
    scores, weight = quality.AttentionModel().scores(x, first)
    assert np.allclose(np.add.reduceat(weight, first[:-1]), 1) and ((scores > 0) & (scores < 1)).all()
    assert np.diff(first).tolist() == [max(1, -(-len(r[1].split()) // quality.PASSAGE_WORDS)) for r in rows[:14]]


def test_poor_texts_are_told_apart(labelled, docs, no_docs, rows):
    table, labels = labelled
    held_out = fold(F.col("doc_id"), 5) == 0
    model = quality.train(examples(table, labels, "quality", ~held_out, 1000))
    out = quality.score(table.withColumn("top_passage", F.lit("x")), model).where(held_out).collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in out]) > 0.95
    assert quality.score(no_docs, model).count() == 0
    odd = quality.score(docs, model).collect()
    assert len(odd) == len(rows) and all(0 <= r["score"] <= 1 and r["top_passage"] >= 0 for r in odd)
    assert 0 < quality.train(examples(table, labels.limit(0), "quality", ~held_out, 10)).scores(*quality.passages(next(chunks(pa.array([""])))))[0][0] < 1

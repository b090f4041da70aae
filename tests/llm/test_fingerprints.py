import numpy as np
import pyarrow as pa
import pytest
from llm.test_text import split

from tidemill.llm import fingerprints as fp
from tidemill.llm.text import chunks


def jaccard(a, b):
    sets = []
    for t in (a, b):
        w = split(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    union = sets[0] | sets[1]
    return len(sets[0] & sets[1]) / len(union) if union else 1.0


def key(doc_id, text):
    return (doc_id is not None, doc_id or 0)


def test_every_text_meets_the_next_one(docs, rows):
    out = fp.with_next(docs).collect()
    assert len(out) == len(rows)
    ordered = sorted(rows, key=lambda r: key(r[0], r[1]))
    ids = [r[0] for r in ordered]
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], set()).add(r[1] or "")
    for r in out:
        last = len(ids) - 1 - ids[::-1].index(r["doc_id"])
        follows = ids[(last + 1) % len(ids)]
        assert r["next_text"] in by_id[follows] | by_id[r["doc_id"]]
        if len(by_id[r["doc_id"]]) == 1 and ids.count(r["doc_id"]) == 1:
            assert r["next_text"] in by_id[follows]


def test_one_row_follows_itself_and_none_is_none(spark, no_docs):
    one = spark.createDataFrame([(5, "abcde")], "doc_id long, text string")
    assert [tuple(r) for r in fp.with_next(one).collect()] == [(5, "abcde", "abcde")]
    assert fp.with_next(no_docs).count() == 0
    assert fp.edited("abcde", "x") == "abcx" and fp.edited("", "x") == "" and fp.edited("abcde", "xyz") == "abcxy"


def test_likeness_estimates_the_similarity(docs):
    out = fp.compare_with_next(fp.with_next(docs)).join(fp.with_next(docs).select("doc_id", "text", "next_text"), "doc_id").where("doc_id IN (0, 1, 3, 4, 5, 6)")
    errors = []
    for r in out.collect():
        errors += [r["near_edited"] - jaccard(r["text"], r["edited"]), r["near_next"] - jaccard(r["text"], r["next_text"])]
    assert np.abs(errors).max() < 0.12 and abs(np.mean(errors)) < 0.03


def test_equal_texts_have_equal_fingerprints(docs, no_docs, rows):
    found = {}
    for r in fp.fingerprint(docs.withColumnRenamed("lang", "fingerprint")).collect():
        assert found.setdefault(r["text"], r["fingerprint"]) == r["fingerprint"]
    assert found[None] == found[""] == found[" \n\t "] == b"" and len(found["one"]) == (1 << fp.BIN_BITS) * fp.STORED_BITS // 8
    assert found["One two"] == found["one two"] != found["one"]
    assert fp.fingerprint(no_docs).count() == 0
    assert fp.likeness(b"", b"") == 1.0 and fp.likeness(b"", found["one"]) == 0.0 == fp.likeness(found["one"], b"")
    assert fp.likeness(found["one"], found["one"]) == 1.0


@pytest.mark.parametrize("n", [1, 3, 40])
def test_densified_bins_stay_unbiased_for_small_sets(n):
    rng = np.random.default_rng(n)
    near, true = [], []
    for i in range(150):
        a = [f"w{i}-{j}" for j in range(n + 4)]
        b = a[: len(a) // 2] + [f"x{i}-{j}" for j in range(len(a) - len(a) // 2)]
        texts = [" ".join(a), " ".join(b)]
        f = [p for c in chunks(pa.array(texts)) for p in fp.packed(c, 1)]
        near.append(fp.likeness(*f))
        true.append(len(set(a) & set(b)) / len(set(a) | set(b)))
    assert abs(np.mean(near) - np.mean(true)) < 0.06 and rng is not None

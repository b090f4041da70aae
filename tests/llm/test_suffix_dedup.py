import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import suffix_dedup as sd
from tidemill.llm.text import prefix_hashes


def brute(texts, length):
    """Kept bytes and maximal removed runs of every text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out.append((bytes(x for x, g in zip(b, gone) if not g), list(zip(edges[::2].tolist(), edges[1::2].tolist()))))
    return out


def removed(df):
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", bytes(r["kept"]), [tuple(s) for s in r["removed"]]) for r in df.collect())


@pytest.mark.parametrize("length,gram", [(200, 64), (24, 8)])
def test_against_brute_force(docs, rows, length, gram):
    expected = brute([r[1] for r in rows], length)
    wanted = sorted((r[0] is None, r[0] or 0, r[1] or "", kept, spans) for r, (kept, spans) in zip(rows, expected))
    assert removed(sd.dedup(docs, length, gram)) == wanted


def test_crowded_anchors_are_taken_apart_with_the_same_result(docs, monkeypatch):
    whole = removed(sd.dedup(docs, 24, 8))
    monkeypatch.setattr(sd, "SEGMENTS_A_TASK", 1)
    assert removed(sd.dedup(docs, 24, 8)) == whole


def test_no_rows_and_clashing_names(spark, no_docs):
    assert sd.dedup(no_docs).count() == 0
    twice = spark.createDataFrame([(1, "x" * 300, 5, "k")], "doc_id long, text string, removed int, key string")
    row = sd.dedup(twice).first()
    assert bytes(row["kept"]) == b"" and row["removed"] == [(0, 300)] and row["key"] == "k"


def test_cut_characters_go_as_a_whole(spark):
    texts = [("é" * 150 + "x",), ("é" * 150 + "y",)]
    out = sd.dedup(spark.createDataFrame(texts, "text string"), 200, 64, as_text=True)
    assert sorted(r["kept"] for r in out.collect()) == ["x", "y"]


def test_suffixes_sort_like_bytes():
    rng = random.Random(3)
    data = bytes(rng.choice(b"ab") for _ in range(400)) + bytes(8)
    at = np.array([rng.randrange(400) for _ in range(300)])
    bucket = np.sort(np.array([rng.randrange(5) for _ in range(300)]))
    order = sd.sort_suffixes(np.frombuffer(data, np.uint8), at, bucket, 8)
    for b in range(5):
        own = np.flatnonzero(bucket == b)
        got = [data[i : i + 8] for i in at[order[own]]]
        assert sorted(at[own].tolist()) == sorted(at[order[own]].tolist()) and got == sorted(got)


def test_hash_collisions_do_not_count(monkeypatch):
    data = np.frombuffer(b"aaaabbbb", np.uint8)
    monkeypatch.setattr(sd, "prefix_hashes", lambda d: np.zeros(len(d) + 1, np.uint64))
    two = np.array([0, 0])
    segment, _ = sd.repeated_starts(data, np.array([0, 4, 8]), two, two, two, 4)
    assert not len(segment)
    monkeypatch.undo()
    assert len(prefix_hashes(data)) == 9


def test_settling_is_the_same_in_any_batches():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randrange(1, 14)
        table = sorted((sd._OPEN, rng.randrange(3), rng.randrange(3), i, rng.random() < 0.2) for i in range(n))
        by_segment = collections.Counter((a, s) for _, a, s, _, _ in table)
        flagged = {(a, s) for _, a, s, _, t in table if t}
        kinds = collections.defaultdict(set)
        for _, a, s, _, _ in table:
            kinds[a].add(s)
        whole = {i for _, a, s, i, t in table if by_segment[a, s] > 1 or t}
        open_ = {(a, s) for _, a, s, _, _ in table if len(kinds[a]) > 1}
        batches, at = [], 0
        while at < n:
            step = rng.randrange(1, 5)
            part = table[at : at + step]
            zeros = [0] * len(part)
            batches.append(sd._result([r[0] for r in part], [r[1] for r in part], [r[3] for r in part], zeros, zeros, zeros, zeros, seal=[r[2] for r in part], twice=[r[4] for r in part]))
            at += step
        out = pa.Table.from_batches(list(sd._settle(batches))).to_pylist()
        assert sorted(r["key"] for r in out if r["kind"] == sd._WHOLE) == sorted(whole), flagged
        heads = [next((a, s) for _, a, s, i, _ in table if i == r["key"]) for r in out if r["kind"] == sd._OPEN]
        assert sorted(heads) == sorted(open_)

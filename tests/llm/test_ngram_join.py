import random

import numpy as np
import pytest
from llm.corpus import SCHEMA
from llm.test_text import split

from tidemill.llm import ngram_join as nj
from tidemill.llm.components import components
from tidemill.session import stage


def grams(text, k):
    w = split(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent):
    """(doc_id, size, component, number of its group) of every row, by comparing all pairs."""
    sets = [grams(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if a and sets[j] and 100 * common >= percent * (len(a) + len(sets[j]) - common):
                root[find(i)] = find(j)
    members = {}
    for i in range(len(rows)):
        members.setdefault(find(i), []).append(rows[i][0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return [(r[0], len(s), least(members[find(i)]) if s else r[0], find(i)) for i, (r, s) in enumerate(zip(rows, sets))]


def order(triples):
    return sorted(tuple((v is not None, v or 0) for v in t) for t in triples)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_against_brute_force(docs, rows, k, percent):
    assert order(map(tuple, nj.join(docs, k, percent).collect())) == order(b[:3] for b in brute(rows, k, percent))


def chains(n):
    """Groups whose members are edited step by step, so that links form chains, stars and misses."""
    rng = random.Random(n)
    out = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(rng.choice([12, 30, 80, 200]))]
        for _ in range(n):
            source = words if rng.random() < 0.5 else rng.choice(out)[1].split() if out else words
            new = list(source)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                new[rng.randrange(len(new))] = f"e{rng.randrange(10**6)}"
            out.append((len(out), " ".join(new), None, None, None))
    return out


@pytest.mark.parametrize("block", [2, 4000])
def test_chains_and_stars(spark, monkeypatch, block):
    monkeypatch.setattr(nj, "BLOCK", block)
    monkeypatch.setattr(nj, "PAIRS_A_TASK", block)
    rows = chains(14)
    got = nj.join(spark.createDataFrame(rows, SCHEMA), 3, 80).collect()
    assert order(map(tuple, got)) == order(b[:3] for b in brute(rows, 3, 80))


@pytest.mark.parametrize("known,few", [(256, 0), (1, 0), (256, 16)])
def test_a_pair_is_named_in_the_first_group_it_meets_in(spark, monkeypatch, known, few):
    named, plain = [], nj.map_stream

    def spied(df, run, schema):
        out = plain(df, run, schema)
        if {"left", "right"} <= set(df.columns):
            named.append(out := stage(out, "named"))
        return out

    monkeypatch.setattr(nj, "map_stream", spied)
    monkeypatch.setattr(nj, "BLOCK", 3)
    monkeypatch.setattr(nj, "KNOWN_GROUPS", known, raising=False)
    monkeypatch.setattr(nj, "FEW", few, raising=False)
    rows = chains(14)
    got = nj.join(spark.createDataFrame(rows, SCHEMA), 3, 80).collect()
    assert order(map(tuple, got)) == order(b[:3] for b in brute(rows, 3, 80))
    pairs = [tuple(r) for r in named[0].collect()]
    assert pairs and (known == 1 or few or len(pairs) == len(set(pairs)))


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(5)
    for percent in (60, 80, 90):
        for size in (1, 5, 9, 10, 19, 40, 101, 400):
            for _ in range(15):
                a = rng.integers(0, 2**63, size, dtype=np.uint64)
                drop = int(rng.integers(0, max(1, size * (100 - percent) // 100) + 1))
                b = np.concatenate([a[drop:], rng.integers(0, 2**63, int(rng.integers(0, drop + 1)), dtype=np.uint64)])
                common = len(set(a.tolist()) & set(b.tolist()))
                if not len(b) or 100 * common < percent * (len(a) + len(b) - common) or set(a.tolist()) == set(b.tolist()):
                    continue
                found = []
                for s in (a, b):
                    s = np.unique(s)
                    found.append(set(nj.signatures(s, np.zeros(len(s), np.int64), np.array([len(s)]), percent)[0].tolist()))
                assert found[0] & found[1]


def test_one_of_each_group(docs, no_docs, rows):
    kept = nj.one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    got = [tuple(r) for r in kept.collect()]
    parts = brute(rows, 5, 80)
    groups = {p[3]: p[2] for p, r in zip(parts, rows) if grams(r[1], 5)}
    empty = [r for r in rows if not grams(r[1], 5)]
    assert len(got) == len(groups) + len(empty)
    assert sorted((r[0] is None, r[0] or 0) for r in got if grams(r[1], 5)) == sorted((g is None, g or 0) for g in groups.values())
    assert nj.one_of_each(no_docs).count() == 0 and nj.join(no_docs).count() == 0


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 100), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 104)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0

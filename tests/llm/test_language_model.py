import collections
import functools
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from llm.test_text import split

from tidemill.llm import language_model as lm


def tokens(text):
    return [*split(text), None]


@pytest.fixture(scope="module")
def trained(docs):
    return lm.train(docs.where("doc_id % 5 <> 1"), context_share=0, follow_share=0)


def test_base_is_exact_and_rows_stay(docs, trained, rows):
    tree, counts = trained
    own = collections.Counter(t for r in rows if r[0] is not None and r[0] % 5 != 1 for t in tokens(r[1]))
    total = sum(own.values())
    assert (tree.total, tree.vocabulary) == (total, len(own))
    wanted = sorted(
        (r[0] is None, r[0] or 0, len(tokens(r[1])), sum(own[t] > 0 for t in tokens(r[1])),
         round(sum(math.log10((own[t] + 0.5) / (total + 0.5 * (len(own) + 1))) for t in tokens(r[1])), 6))
        for r in rows
    )
    scored = lm.score(docs, tree, counts).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in scored) == wanted
    assert {r["train_tokens"] for r in scored} == {total}


def test_shares_change_the_tree_but_not_the_base(docs, trained):
    few = lm.train(docs.where("doc_id % 5 <> 1"), context_share=0.01, follow_share=0.002)
    assert len(few[0].words) < len(trained[0].words) / 2
    a, b = (sorted((r["doc_id"] or -1, r["n_known"], round(r["base_score"], 6)) for r in lm.score(docs, *t).collect()) for t in (few, trained))
    assert a == b


class PlainTree:
    """The same model from plain counts, every context looked at: retained where its plain frequencies diverge from
    those of its longest retained suffix, discounted, else the shorter one."""

    def __init__(self, train, depth):
        self.one = collections.Counter(w for ts in train for w in ts)
        self.total, self.vocabulary = sum(self.one.values()), len(self.one)
        self.retained = {}
        for k in range(1, depth + 1):
            follow = collections.defaultdict(collections.Counter)
            for ts in train:
                for i in range(k, len(ts)):
                    follow[tuple(ts[i - k : i])][ts[i]] += 1
            found = {}
            for s, words in follow.items():
                of, kept = sum(words.values()), {w: n for w, n in words.items() if n >= 2}
                if of < 2 or not kept:
                    continue
                q = {w: self.plain(s[1:], w) for w in kept}
                saved = sum(n * math.log2(n / of / q[w]) for w, n in kept.items())
                if saved >= lm.DIVERGENCE * of and saved >= len(kept) * math.log2(of + 1) / 2:
                    p = {w: (n - lm.DISCOUNT) / of for w, n in kept.items()}
                    rest = max(1 - sum(p.values()), 1e-9) / (1 - min(sum(self.probability(s[1:], w) for w in kept), 1 - 1e-9))
                    found[s] = (p, {w: n / of for w, n in kept.items()}, rest)
            self.retained.update(found)

    def longest(self, s):
        while s and s not in self.retained:
            s = s[1:]
        return s

    def plain(self, s, w):
        s = self.longest(s)
        return self.retained[s][1][w] if s else self.one[w] / self.total

    def probability(self, s, w):
        s = self.longest(s)
        if not s:
            return (self.one[w] + 0.5) / (self.total + 0.5 * (self.vocabulary + 1))
        p, _, gamma = self.retained[s]
        return p[w] if w in p else gamma * self.probability(s[1:], w)

    def score(self, ts, depth):
        return sum(math.log10(self.probability(tuple(ts[max(0, i - depth) : i]), w)) for i, w in enumerate(ts))


def test_scores_follow_the_tree_word_by_word(docs, trained, rows):
    tree, counts = trained
    plain = PlainTree([tokens(r[1]) for r in rows if r[0] is not None and r[0] % 5 != 1], 2)
    wanted = sorted((r[0] or -1, round(plain.score(tokens(r[1]), 2), 5)) for r in rows)
    got = sorted((r["doc_id"] or -1, round(r["score"], 5)) for r in lm.score(docs, tree, counts).collect())
    assert np.allclose(np.array(got), np.array(wanted), atol=2e-4)
    assert {len(s) for s in plain.retained} == {1, 2}


def repetitive():
    """Near copies of long passages, a change here and there, lines said over and over, and common prose."""
    rng = random.Random(8)
    prose = lambda n: [rng.choice("the a of in on it was by to and so but".split()) for _ in range(n)]
    passage = [f"w{i}" for i in range(45)]
    texts = []
    for i in range(24):
        words = list(passage)
        for _ in range(i % 4):
            words[rng.randrange(15, 45)] = rng.choice(["red", "blue"])
        texts.append(prose(rng.randint(0, 12)) + words + prose(rng.randint(0, 30)))
    # What comes at the end depends on a word far before it.
    texts += [[f"key{i % 9}", *"so it went on and on as ever before".split(), f"value{i % 9}"] for i in range(63)]
    texts += [prose(80) for _ in range(30)] + [["loop"] * 40, ["tick", "tock"] * 20, ["tick", "tock", "tack"] * 15, []]
    return [" ".join(t) for t in texts]


@functools.cache
def plain_tree():
    return PlainTree([tokens(t) for t in repetitive()[::2]], 100)


@pytest.mark.parametrize(("before", "further", "group", "grown"), [(24, 8, 500_000, 100_000), (3, 3, 4, 50)])
def test_contexts_of_any_length_as_if_all_were_looked_at(spark, monkeypatch, before, further, group, grown):
    for name, value in (("BEFORE", before), ("FURTHER", further), ("GROUP", group), ("_GROWN", grown)):
        monkeypatch.setattr(lm, name, value)
    texts = repetitive()
    plain = plain_tree()
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    tree, counts = lm.train(frame.where("doc_id % 2 = 0"), depth=None)
    got = {r["doc_id"]: r["score"] for r in lm.score(frame, tree, counts).collect()}
    assert tree.depth == max(map(len, plain.retained)) > 10
    contexts = sum(len(s) > 3 for s in plain.retained)
    assert contexts > 10 and np.allclose([got[i] for i in range(len(texts))], [plain.score(tokens(t), 100) for t in texts], atol=2e-4)


def test_nothing_to_learn_from(docs, no_docs, rows):
    tree, counts = lm.train(no_docs)
    out = lm.score(docs, tree, counts).collect()
    assert len(out) == len(rows) and all(r["n_known"] == 0 and r["base_score"] == r["score"] == 0 for r in out)
    assert lm.score(no_docs, tree, counts).count() == 0
    with pytest.raises(ValueError):
        lm.train(docs, depth=3)


def test_rare_phrases_are_learned_from_a_large_corpus(spark):
    """What occurs three times stays in the tree however many tokens there are besides."""
    phrase = "seven grey geese watch from the old stone wall"
    table = [(i, "pad " * 5000 + (phrase if i < 3 else "")) for i in range(100)]
    train = spark.createDataFrame(table, "doc_id long, text string")
    tree, counts = lm.train(train)
    assert tree.total > 400_000
    (got,) = lm.score(spark.createDataFrame([(1, phrase)], train.schema), tree, counts).collect()
    # All words but the first follow their context with probability 5 in 6.
    first = math.log10((3 + 0.5) / (tree.total + 0.5 * (tree.vocabulary + 1)))
    assert abs(got["score"] - (first + 9 * math.log10(2.5 / 3))) < 1e-6


def test_depth_grows_while_contexts_diverge(spark):
    """The word behind two equal words depends on the third before it."""
    table = [(i, ("a x y left", "b x y right", "z y other")[i % 3]) for i in range(90)]
    train = spark.createDataFrame(table, "doc_id long, text string")
    two, grown = lm.train(train), lm.train(train, depth=None)
    texts = spark.createDataFrame([(1, "a x y left"), (2, "a x y right")], train.schema)
    a, b = ({r["doc_id"]: r["score"] for r in lm.score(texts, *t).collect()} for t in (two, grown))
    assert grown[0].depth == 3 and b[1] > a[1] + 0.2 and b[2] < a[2] - 0.5 and abs(a[1] - a[2]) < 1e-9


def test_runs_by_join_score_like_runs_sent_along(docs, trained, rows, monkeypatch):
    tree, counts = trained
    score = lambda: sorted((r["doc_id"] or -1, round(r["score"], 5)) for r in lm.score(docs, tree, counts).collect())
    sent = score()
    monkeypatch.setattr(lm, "SENT_SHARE", 1.0)
    assert np.allclose(np.array(score()), np.array(sent), atol=2e-4)


def test_a_passage_is_dealt_out_once_for_neighbouring_contexts(spark):
    """Contexts of 40 words of one long passage, all of them open: their stretches overlap no more than their anchors do."""
    passage = " ".join(f"w{i}" for i in range(400))
    texts = spark.createDataFrame([(i, passage) for i in range(3)], "doc_id long, text string").repartition(1)
    token = lm._tokens(next(lm.chunks(pa.array([passage]))))[0]
    contexts = lm._Runs(token).keys(np.arange(360), 40)
    opened = spark.createDataFrame([(int(key),) for key in contexts.view(np.int64)], "key long")
    rows = [lm._stretches_of(bytes(r["data"])) for r in lm._gathered(texts, opened, 40, 60, 5).collect()]
    places, dealt = (sum(int(x.sum()) for x in parts) for parts in zip(*((r[1], r[2]) for r in rows)))
    # Every place with a word before its context; a stretch of 100 words for each of them before.
    assert places == 3 * 359 and dealt < 20 * places
    # Equal contexts are dealt out by the same anchor wherever they stand.
    shifted = np.concatenate([token[100:], token[:100]])
    assert len(token) == 401
    one, other = lm._Runs(token), lm._Runs(shifted)
    assert (lm._anchors(one, np.arange(100, 360), 40) == 100 + lm._anchors(other, np.arange(260), 40)).all()


def test_equal_places_are_dealt_out_once_with_their_number(spark):
    passage = " ".join(f"w{i}" for i in range(400))
    texts = spark.createDataFrame([(i, passage) for i in range(3)], "doc_id long, text string").repartition(1)
    token = lm._tokens(next(lm.chunks(pa.array([passage]))))[0]
    contexts = lm._Runs(token).keys(np.arange(360), 40)
    opened = spark.createDataFrame([(int(key),) for key in contexts.view(np.int64)], "key long")
    rows = [lm._stretches_of(bytes(r["data"])) for r in lm._gathered(texts, opened, 40, 60, 5).collect()]
    assert sum(len(r[4]) for r in rows) == 359 and sum(int(r[5].sum()) for r in rows) == 3 * 359


class Texts:
    """Stands for a table: what a pass does in a task is run here instead."""

    def select(self, *columns):
        return self


def test_a_counting_task_holds_little(monkeypatch):
    """Seven megabytes of words, pairs of which hardly repeat, one of them common: counts are whole, memory is bounded."""
    monkeypatch.setattr(lm, "_HELD", 100_000)
    monkeypatch.setattr(lm, "map_stream", lambda df, run, schema: run)
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 40_000, 12_000).tolist())) + " common pair" for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])

    def ends(chunk):
        token, row, first = lm._tokens(chunk)
        at = np.arange(len(token))
        at = at[at - first[row] >= 1]
        return token, at, np.ones(len(at), bool)

    run = lm._count(Texts(), 2, ends, 5)
    tracemalloc.start()
    out = list(run(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    total, most = 0, 0
    for data in (x.as_py() for b in out for x in b.column(1)):
        word, place = lm._unpacked_words(data, 0)
        n, _ = lm.unpacked(data, place, len(word) // 2)
        total, most = total + int(n.sum()), max(most, len(n))
    assert total == sum(len(t.split()) for t in texts)
    assert most <= 10_000 and peak < 60e6


def test_few_others_pass_a_sieve(spark):
    """One in sixteen passed before, and most of what growth dealt out was let through by chance."""
    keys = spark.range(300_000).select(lm.F.xxhash64("id").alias("key"))
    sieve = lm.Sieve(keys)
    assert sieve.lets_through(keys.toArrow().column("key").to_numpy().view(np.uint64)).all()
    others = np.random.default_rng(3).integers(0, 1 << 63, 200_000).astype(np.uint64) * np.uint64(2)
    assert sieve.lets_through(others).mean() < 0.02
    assert not lm.Sieve(keys.limit(0)).lets_through(others).any()


class Open:
    """Stands for a sieve: two in three contexts, or all of them, are open."""

    def __init__(self, every):
        self.every, self.asked = every, 0

    def lets_through(self, keys):
        self.asked += 1
        return keys % np.uint64(3) > 0 if not self.every else np.ones(keys.shape, bool)


@pytest.mark.parametrize("every", [True, False])
def test_long_runs_are_looked_up_in_few_steps(every):
    """All runs that may be in the tree, in much fewer steps than the longest has words."""
    texts = [" ".join(f"w{i % 97}" for i in range(n)) for n in (300, 1, 0, 40)]
    token, row, first = lm._tokens(next(lm.chunks(pa.array(texts))))
    opened = Open(every)
    own = lm._Sent(None, None, None, None, None, opened, 250)
    found = list(lm._candidates(token, row, first, own))
    got = collections.Counter((int(p), int(k)) for places, keys in found for p, k in zip(places, keys))
    runs, wanted = lm._Runs(token), collections.Counter()
    plain = Open(every)
    for at in range(len(token)):
        deepest = {}
        for end in (at, at - 1):
            deepest[end] = 0
            while end >= first[row[at]] and deepest[end] < end + 1 - first[row[at]]:
                length = deepest[end] + 1
                if not plain.lets_through(runs.keys(np.array([end + 1 - length]), length))[0]:
                    break
                deepest[end] = length
        # A context is open without its first word, or a next word stands behind such a context.
        reach = max(deepest[at] + 1, deepest[at - 1] + 2 if at > first[row[at]] else 1)
        for length in range(1, min(reach, 250, at + 1 - first[row[at]]) + 1):
            wanted[at, int(runs.keys(np.array([at + 1 - length]), length)[0])] += 1
    assert got == wanted
    assert len(found) < 60 and opened.asked < 60


def test_a_context_with_many_next_words_is_judged_in_parts(monkeypatch):
    """Rows of one context that are too many for a task's memory wait in a file, with the same outcome."""
    rng = np.random.default_rng(4)
    rows = [(7, None, 5000, None, None), (9, None, 30, None, None), (1, None, 4, None, None)]
    rows += [(7, 100 + i, int(rng.integers(2, 60)), float(-rng.random() * 4 - 1), float(-rng.random() * 9)) for i in range(300)]
    rows += [(9, 900 + i, 10, -2.0, -6.0) for i in range(3)] + [(1, 990, 3, -2.0, -6.0), (3, 991, 3, -2.0, -6.0)]
    rows.sort(key=lambda r: r[0])
    schema = pa.schema([("context", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("log", pa.float64()), ("q", pa.float64())])
    batches = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema).to_batches(max_chunksize=16)

    def judged():
        out = pa.Table.from_batches(lm._judged(lm._Limits(2, 2, 0.02), False)(iter(batches))).to_pylist()
        plain = [tuple(round(x, 9) if isinstance(x, float) else x for x in r.values()) for r in out]
        return sorted(plain, key=str)

    whole = judged()
    monkeypatch.setattr(lm, "_HELD", 40)
    files = []
    monkeypatch.setattr(lm.tempfile, "TemporaryFile", lambda make=lm.tempfile.TemporaryFile: files.append(make()) or files[-1])
    assert judged() == whole and files
    # The context that no row tells how often it occurs is none.
    assert {r[0] for r in whole if r[-1]} <= {7, 9, 1} and any(r[-1] for r in whole)

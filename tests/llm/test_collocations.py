import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import collocations
from tidemill.llm.text import session

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_force(rows, longest, least, first):
    """The contract word for word: (lang, rank, phrase, a, l, r, n, score)."""
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[ \t]+", piece) if x]
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    often = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    inside = {}
    for (lang, p), a in often.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                inside[lang, p[i : i + k]] = max(inside.get((lang, p[i : i + k]), 0), a)
    out = []
    for lang in {key[0] for key in often}:
        scored = []
        for (other, p), a in often.items():
            if other != lang or inside.get((lang, p), 0) >= a:
                continue
            cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    vocabulary = ["the", "The", "of", "é", "ß", "and", "x"]
    rows = []
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
        if rng.random() < 0.4:
            words[3:3] = ["New", "York", "city", "council", "said"][: rng.randint(2, 5)]
        text = "".join(w + rng.choice([" ", "  ", "\t", " ", ", ", ".\n", "\x0b"]) for w in words)
        rows.append((text, rng.choice(["en", "de", None, "und"])))
    return [*rows, (None, "en"), ("", None), ("go " * 400, "fr"), rows[0], rows[0], (" \t.,", "es")]


@pytest.mark.parametrize(("longest", "least", "first"), [(5, 4, 2000), (5, 12, 25), (3, 2, 10)])
def test_phrases_match_the_contract(spark, longest, least, first):
    rows = corpus()
    frame = session(spark).createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, n int, phrase string").repartition(5)
    found = sorted(tuple(r) for r in collocations.collocations(frame, longest=longest, least=least, first=first).collect())
    assert found == brute_force(rows, longest, least, first)


def test_tiny_memories_change_nothing(spark, monkeypatch):
    rows = corpus()
    monkeypatch.setattr(collocations, "_HELD", 7)
    monkeypatch.setattr(collocations, "_WALKED", 3)
    frame = session(spark).createDataFrame(rows, "text string, lang string")
    found = sorted(tuple(r) for r in collocations.collocations(frame, least=4).collect())
    assert found == brute_force(rows, 5, 4, 2000)


def test_no_rows_and_nothing_frequent(spark):
    empty = session(spark).createDataFrame([], "text string, lang string")
    assert collocations.collocations(empty).collect() == []
    assert collocations.collocations(spark.createDataFrame([("a b c", "en")], "text string, lang string")).collect() == []


def test_automata_written_united_and_walked():
    rng = np.random.default_rng(1)
    paths = np.unique(rng.integers(0, 4, (60, 3)).astype(np.uint64) + np.uint64(1), axis=0)
    weights = np.arange(1, len(paths) + 1)
    automaton = collocations.CountAutomaton(3)
    for start in range(0, len(paths), 7):
        automaton.add(paths[start : start + 7], np.full(len(paths[start : start + 7]), 3), weights[start : start + 7])
    assert automaton.sizes[0] == len(np.unique(paths[:, 0]))
    again = collocations.CountAutomaton.from_bytes(automaton.to_bytes())
    for a in (automaton, again):
        got, n = a.paths()
        assert (got == paths).all() and (n == weights).all()
        assert (a.walk(paths, 3)[:, 2] == weights).all()
        assert a.walk(np.full((1, 3), 99, np.uint64), 3).tolist() == [[0, 0, 0]]


def test_weights_of_inner_states():
    automaton = collocations.CountAutomaton(3)
    paths = np.array([[1, 0, 0], [1, 2, 0], [1, 2, 5], [3, 2, 0]], np.uint64)
    automaton.add(paths, np.array([1, 2, 3, 2]), np.array([9, 8, 7, 6]))
    assert automaton.walk(paths, 3).tolist() == [[9, 0, 0], [9, 8, 0], [9, 8, 7], [0, 6, 0]]

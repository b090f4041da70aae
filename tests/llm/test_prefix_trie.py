import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemill.llm import prefix_trie
from tidemill.llm.text import session

SCHEMA = "conv_id long, turn long, role string, text string, depth long, k1 string"


def rebuilt(rows, shared):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    if not shared:
        return own
    out = {}
    for c, turns in own.items():
        h = 0 if c is None else zlib.crc32(str(c).encode()) % 6
        base = [] if c is None else own.get(c - int(c - 100 * int(c / 100) if c < 0 else c % 100), [])
        out[c] = base[:h] + turns[h:]
    return out


def brute_force(rows, shared=True):
    convs = rebuilt(rows, shared)
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    smallest = {p: min((c for c in m if c is not None), default=None) for p, m in members.items()}
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, sums = [], {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(sums[q][0] for q in children[p]) or 1
        saved = sum(sums[q][1] for q in children[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        sums[p] = leaves, saved
        ends = sorted((c is not None, c or 0) for c in members[p] if tuple(convs[c]) == p)
        text = ",".join(str(c) if known else "" for known, c in ends)
        out.append((smallest[p], len(p), smallest[p[:-1]] if p else None, len(members[p]), len(children[p]), leaves, saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed=1, n=260):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-20, 700), n):
        # Few different turns, so that conversations share their beginnings and repeat each other.
        for turn in range(rng.choice([0, 1, 2, 3, 4, 9])):
            rows.append((c, turn if rng.random() < 0.97 else None, rng.choice(["user", "assistant"]) if turn % 3 else "user", rng.choice(["a", "é b", "", None]) if turn else "hello"))
    rows += [(1000, t, "user", f"long {t % 2}") for t in range(300)] + [(1001, t, "user", f"long {t % 2}") for t in range(299)]
    rows += [(c, 0, "user", "same") for c in range(2000, 2100)] + [(2100, 0, "user", "same"), (2100, 1, None, None)]
    rows += [(None, 1, "user", "lost"), (None, None, None, None), rows[0], rows[0], (3000, 5, "user", "x" * 70_000), (3000, 5, "user", "y"), (3000, 5, "assistant", "z")]
    return rows


def trie(spark, rows, shared=True, **options):
    frame = session(spark).createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(7)
    conv = F.col("conv")
    given = (conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, 5) if shared else ()
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(frame, *given, **options).collect()), key=repr)


@pytest.mark.parametrize("group", [prefix_trie.GROUP, 5])
def test_nodes_match_the_contract(spark, group):
    rows = conversations()
    assert trie(spark, rows, group=group) == brute_force(rows)


def test_without_rebuilding_and_in_small_steps(spark, monkeypatch):
    rows = conversations(2, 120)
    monkeypatch.setattr(prefix_trie, "_PEELED", 10)
    monkeypatch.setattr(prefix_trie, "_CHUNK", 16)
    assert trie(spark, rows, shared=False, group=40) == brute_force(rows, shared=False)


def test_no_rows_and_one(spark):
    assert trie(spark, []) == []
    assert trie(spark, [(7, None, None, None)], shared=False) == brute_force([(7, None, None, None)], shared=False)


def test_a_conversation_without_turns(spark):
    # 305 takes its first turns from 300, which is absent, and has none of its own behind them.
    c = next(c for c in range(301, 399) if zlib.crc32(str(c).encode()) % 6 > 0)
    assert trie(spark, [(c, 0, "user", "hi")]) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_a_conversation_that_is_most_of_the_rows(spark):
    rows = [(1, t, "user", f"{t % 7}") for t in range(3000)] + [(2, t, "user", f"{t % 7}") for t in range(500)]
    assert trie(spark, rows, shared=False, group=700) == brute_force(rows, shared=False)

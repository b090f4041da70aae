import random

import pytest

from tidemill.llm.contamination import contamination, greedy_tiles

ITEM = "the quick brown fox jumps over the lazy dog while seven grey geese watch from the old stone wall by the river".split()


def naive(item, text, least):
    """Longest match first, one at a time."""
    free_item, free_text, tiles = [True] * len(item), [True] * len(text), []
    while True:
        best = None
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and free_item[p + n] and free_text[t + n] and item[p + n] == text[t + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, p, t)
        if best is None:
            return tiles
        n, p, t = best
        tiles.append((p, t, n))
        free_item[p : p + n] = [False] * n
        free_text[t : t + n] = [False] * n


def test_tiles_cover_as_much_as_one_at_a_time():
    rng = random.Random(2)
    for _ in range(300):
        item = [rng.randrange(3) for _ in range(rng.randrange(0, 14))]
        text = [rng.randrange(3) for _ in range(rng.randrange(0, 18))]
        ours, plain = greedy_tiles(item, text, 2), naive(item, text, 2)
        assert ours[:1] == plain[:1]
        for p, t, n in ours:
            assert n >= 2 and item[p : p + n] == text[t : t + n]
        for side in (0, 1):
            used = [i for tile in ours for i in range(tile[side], tile[side] + tile[2])]
            assert len(used) == len(set(used))
        # With the same longest tile first, what is covered differs at most by ties.
        assert abs(sum(x[2] for x in ours) - sum(x[2] for x in plain)) <= 3


def test_tiles_are_those_of_one_at_a_time():
    rng = random.Random(5)
    for _ in range(1500):
        item = [rng.randrange(3) for _ in range(rng.randrange(0, 24))]
        text = [rng.randrange(3) for _ in range(rng.randrange(0, 30))]
        assert greedy_tiles(item, text, 2) == naive(item, text, 2)


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, " ".join(ITEM)), (2, "one two three"), (3, None), (4, "alpha beta gamma delta epsilon zeta eta theta"), (4, "alpha beta gamma delta epsilon zeta eta theta")]
    return spark.createDataFrame(items, "item_id long, text string")


def found(df):
    return {r["doc_id"]: sorted((h["item_id"], round(h["coverage"], 3)) for h in r["hits"]) for r in df.collect()}


def texts():
    half = len(ITEM) // 2
    return {
        1: "before " + " ".join(ITEM) + " after",
        2: " ".join([*ITEM[half:], "and", "then", *ITEM[:half]]).upper(),
        3: " ".join(w + "," for w in ITEM),
        4: " ".join(ITEM[:5]) + " something else altogether",
        5: " ".join(reversed(ITEM)),
        6: "one two three",
        7: " ".join(ITEM[:9]) + " x " + " ".join(ITEM[12:]),
    }


def test_whole_reordered_and_punctuated_passages_are_caught(spark, benchmark):
    hits = found(contamination(spark.createDataFrame(list(texts().items()), "doc_id long, text string"), benchmark))
    assert hits[1] == hits[2] == hits[3] == [(1, 1.0)]
    assert hits[4] == hits[5] == hits[6] == []
    assert hits[7] == [(1, round((len(ITEM) - 3) / len(ITEM), 3))]


def test_blocks_give_the_same(spark, benchmark):
    docs = spark.createDataFrame([*texts().items(), (8, "alpha beta gamma delta epsilon zeta eta theta")], "doc_id long, text string")
    assert found(contamination(docs, benchmark, block_bytes=40)) == found(contamination(docs, benchmark))


def test_odd_rows(docs, no_docs, benchmark, rows):
    out = contamination(docs.withColumnRenamed("lang", "hits"), benchmark).collect()
    assert len(out) == len(rows) and not any(r["hits"] for r in out)
    assert contamination(no_docs, benchmark).count() == 0
    assert not any(r["hits"] for r in contamination(docs, benchmark.limit(0)).collect())

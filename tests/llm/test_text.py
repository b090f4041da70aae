import re

import numpy as np
import pyarrow as pa

from tidemill.llm.text import chunks, counts_by_row, positions, prefix_hashes, shingles, stretch_hash, words


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_words_are_those_of_the_pattern_at_any_chunk_size(rows):
    texts = [r[1] for r in rows]
    for size in (1, 100, 1 << 20):
        found = []
        for chunk in chunks(pa.array(texts, pa.string()).slice(1), size):
            w = words(chunk)
            for r in range(chunk.rows):
                low = w.first[r], w.first[r + 1]
                found.append([bytes(chunk.bytes[s:e]).decode() for s, e in zip(w.start[slice(*low)], w.end[slice(*low)])])
        plain = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts[1:]]
        assert found == plain


def test_equal_words_and_shingles_have_equal_hashes_anywhere(rows):
    seen = {}
    for size in (50, 1 << 20):
        row = 0
        for chunk in chunks(pa.array([r[1] for r in rows], pa.string()), size):
            w = words(chunk)
            hashes, of = shingles(w, 3)
            for r in range(chunk.rows):
                own = split(rows[row + r][1])
                grams = [tuple(own[i : i + 3]) for i in range(len(own) - 2)] if len(own) >= 3 else [tuple(own)] if own else []
                assert len(grams) == (of == r).sum()
                for gram, h in zip(grams, hashes[of == r].tolist()):
                    assert seen.setdefault(gram, h) == h
            row += chunk.rows
    assert len(set(seen.values())) == len(seen)


def test_stretches_hash_alike_wherever_they_stand():
    data = np.frombuffer(b"abcabcxabc", np.uint8)
    h = prefix_hashes(data)
    at = np.array([0, 3, 7])
    assert len(set(stretch_hash(h, at, at + 3).tolist())) == 1
    assert stretch_hash(h, np.array([0]), np.array([3])) != stretch_hash(h, np.array([1]), np.array([4]))


def test_counts_and_positions():
    h, r, n = counts_by_row(np.array([5, 5, 2, 5], np.uint64), np.array([0, 0, 0, 1]))
    assert (h.tolist(), r.tolist(), n.tolist()) == ([2, 5, 5], [0, 0, 1], [1, 2, 1])
    assert positions(np.array([2, 5]), np.array([5, 3, 2, 9])).tolist() == [1, -1, 0, -1]
    assert positions(np.array([], np.int64), np.array([1])).tolist() == [-1]

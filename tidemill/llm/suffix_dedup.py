"""Removal of byte strings that occur more than once anywhere, by hash-compared suffix sorting.

A whole corpus of suffixes would be many times the corpus, so only suffixes that can have an equal are sorted.
Every string of ``length`` bytes has an *anchor*: its smallest hashed gram. Consecutive strings with one
anchor form a *segment*. Equal strings have equal anchors at the same offset, so:

1. Segments are shuffled by anchor, as a few numbers each. A segment equal to another is repeated as a whole;
   one whose anchor occurs nowhere else holds no repeated string.
2. What is left, segments that share an anchor but differ, is fetched as bytes. Their suffixes at equal
   offsets are merge-sorted. Two suffixes are compared by the length of their common extension, found by
   binary search on prefix hashes, and the byte behind it. Neighbours whose extension is ``length`` are
   repeated; their bytes are compared, so no hash collision removes anything.
3. The repeated ranges go to their documents.

An anchor with very many different segments is taken apart into single strings, by a hash of each, so that it
does not meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.text import chunks, map_stream, mix, prefix_hashes, stretch_hash
from tidemill.session import stage

LENGTH = 200
GRAM = 64
# Different segments of one anchor beyond which they are taken apart.
SEGMENTS_A_TASK = 20_000
# Suffixes sorted at a time.
_BATCH_SUFFIXES = 300_000

_WHOLE, _OPEN = 0, 1
_RESULT = "kind int, anchor long, key long, size int, start int, back int, span int"


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbouring values, by prefix and suffix minima of blocks of that width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Segments of the texts in ``data``: (anchor hash, anchor position, first start, last start), in order."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    hashes = prefix_hashes(data)
    at = np.arange(n - gram + 1)
    grams = mix(stretch_hash(hashes, at, at + gram))
    # Position in the low bits: of equal grams the first counts, which equal strings agree on.
    low = np.uint64(max(1, int(n).bit_length()))
    ordered = (grams >> low << low) | at.astype(np.uint64)
    smallest = (_window_minima(ordered, length - gram + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    row = np.searchsorted(offsets, np.arange(n - length + 1), side="right") - 1
    starts = np.flatnonzero(np.arange(n - length + 1) + length <= offsets[row + 1])
    chosen = smallest[starts]
    first = np.ones(len(starts), bool)
    first[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1)
    begin = np.flatnonzero(first)
    end = np.append(begin[1:], len(starts)) - 1
    return grams[chosen[begin]], chosen[begin], starts[begin], starts[end]


def _map_segments(length: int, gram: int):
    """Mapper from (key, text) to result rows: ranges already known to be repeated, and one open row for each
    different segment of a chunk with its contents' hash in ``seal``."""

    def run(batches):
        for batch in batches:
            keys, row = batch.column(0).to_numpy(), 0
            for chunk in chunks(batch.column(1)):
                anchor, at, s0, s1 = segments(chunk.bytes, chunk.offsets, length, gram)
                owner = np.searchsorted(chunk.offsets, s0, side="right") - 1
                key = keys[row + owner]
                size = np.diff(chunk.offsets)[owner]
                start = s0 - chunk.offsets[owner]
                row += chunk.rows
                view = memoryview(chunk.bytes)
                digest = xxhash.xxh3_64_intdigest
                seal = np.array([digest(view[a:b]) for a, b in zip(s0.tolist(), (s1 + length).tolist())], np.uint64)
                seal = mix(seal + mix(((at - s0) << 20 | (s1 - s0)).astype(np.uint64)))
                order = np.lexsort((start, key, seal, anchor))
                same = np.zeros(len(order), bool)
                same[1:] = (anchor[order][1:] == anchor[order][:-1]) & (seal[order][1:] == seal[order][:-1])
                more = same.copy()
                more[:-1] |= same[1:]
                keep = order[~same]
                twice = more[~same]
                # Known ranges travel by their document, so that a frequent string does not draw them together.
                done = order[more]
                yield _result(
                    np.concatenate([np.full(len(keep), _OPEN), np.full(len(done), _WHOLE)]),
                    np.concatenate([anchor[keep].view(np.int64), mix(key[done].view(np.uint64)).view(np.int64)]),
                    *[np.concatenate([x[keep], x[done]]) for x in (key, size, start, at - s0, s1 - s0)],
                    seal=np.concatenate([seal[keep].view(np.int64), np.zeros(len(done), np.int64)]),
                    twice=np.concatenate([twice, np.zeros(len(done), bool)]),
                )

    return run


def _result(kind, anchor, key, size, start, back, span, **more) -> pa.RecordBatch:
    columns = {
        "kind": pa.array(kind, pa.int32()), "anchor": pa.array(anchor, pa.int64()), "key": pa.array(key, pa.int64()),
        "size": pa.array(size, pa.int32()), "start": pa.array(start, pa.int32()), "back": pa.array(back, pa.int32()),
        "span": pa.array(span, pa.int32()),
    }
    columns |= {k: pa.array(v) for k, v in more.items()}
    return pa.RecordBatch.from_pydict(columns)


def _settle(batches):
    """From rows sorted by (kind, anchor, seal): whole segments that are repeated, and one open row for each
    different segment of an anchor that has several. Holds one row from batch to batch."""
    held: dict | None = None
    names = ["kind", "anchor", "key", "size", "start", "back", "span"]
    for batch in batches:
        c = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (*names, "seal", "twice")}
        if not batch.num_rows:
            continue
        open_ = c["kind"] == _OPEN
        known = {n: c[n][~open_] for n in names}
        c = {n: v[open_] for n, v in c.items()}
        if held is not None:
            c = {n: np.concatenate([held[n], v]) for n, v in c.items()}
        n = len(c["anchor"])
        if n:
            same_anchor = c["anchor"][1:] == c["anchor"][:-1]
            same_seal = same_anchor & (c["seal"][1:] == c["seal"][:-1])
            whole = c["twice"].copy()
            whole[1:] |= same_seal
            whole[:-1] |= same_seal
            first = np.ones(n, bool)  # of its segment
            first[1:] = ~same_seal
            mixed = np.zeros(n, bool)  # a different segment of the anchor stands before or behind
            mixed[1:] |= same_anchor & ~same_seal
            # Behind: the next row that starts a segment belongs to the same anchor.
            heads = np.flatnonzero(first)
            mixed[heads[:-1]] |= c["anchor"][heads[1:]] == c["anchor"][heads[:-1]]
            if held is not None:
                first[0] &= not held["told_first"][0]
                mixed[0] |= held["told_mixed"][0]
                whole[0] |= held["told_whole"][0]
            tell_whole = whole.copy()
            tell_open = first & mixed
            if held is not None and held["told_whole"][0]:
                tell_whole[0] = False
            # The head of the last segment may yet turn out mixed, the last row whole: carry both on.
            last_head = int(heads[-1])
            carry = n - 1
            if last_head != n - 1 and not tell_open[last_head] and first[last_head]:
                # The head has to be told later: it stands in for the last row, which is whole by now.
                carry = last_head
            state = {
                "told_first": np.array([bool(tell_open[carry] or not first[carry])]),
                "told_mixed": np.array([bool(mixed[carry])]),
                "told_whole": np.array([bool(whole[carry])]),
            }
            held = {k: v[carry : carry + 1] for k, v in c.items()} | state
            w, o = np.flatnonzero(tell_whole), np.flatnonzero(tell_open)
            out = {k: np.concatenate([known[k], c[k][w], c[k][o]]) for k in names}
            out["kind"] = np.concatenate([known["kind"], np.full(len(w), _WHOLE), np.full(len(o), _OPEN)])
        else:
            out = known
        yield _result(**out)


def _extension(hashes: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """Length of the common extension of suffixes at ``x`` and ``y``, at most ``length``."""
    low, high = np.zeros(len(x), np.int64), np.full(len(x), length)
    for _ in range(int(length).bit_length()):
        middle = (low + high + 1) // 2
        same = stretch_hash(hashes, x, x + middle) == stretch_hash(hashes, y, y + middle)
        low = np.where(same, middle, low)
        high = np.where(same, high, middle - 1)
    return low


def _less(data: np.ndarray, hashes: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the suffix at ``x`` sorts before the one at ``y``, and whether they are equal."""
    common = _extension(hashes, x, y, length)
    equal = common == length
    step = np.where(equal, 0, common)
    return ~equal & (data[x + step] < data[y + step]), equal


def sort_suffixes(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Order of suffixes (first ``length`` bytes) within their buckets, which stand together in ``bucket``.

    A bottom-up mergesort: an element's place in a merged run is its place in its own run plus its rank in
    the other, found by binary search; all runs of one level are merged together.
    """
    hashes = prefix_hashes(data)
    n = len(at)
    order = np.arange(n)
    starts = np.flatnonzero(np.diff(bucket, prepend=bucket[0] - 1 if n else 0))
    begin = np.repeat(starts, np.diff(np.append(starts, n)))
    end = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    within = np.arange(n) - begin
    width = 1
    while n and width < (end - begin).max():
        run = within // width
        left = run % 2 == 0
        other = begin + np.where(left, run + 1, run - 1) * width
        active = np.flatnonzero(~left | (other < end))
        mine, is_left = at[order[active]], left[active]
        low, stop = other[active], np.minimum(other[active] + width, end[active])
        base, high = low.copy(), stop.copy()
        while True:
            todo = np.flatnonzero(low < high)
            if not len(todo):
                break
            middle = (low[todo] + high[todo]) // 2
            before, equal = _less(data, hashes, at[order[middle]], mine[todo], length)
            # Equal ones of the left run come first, so that the sort is stable.
            before |= equal & ~is_left[todo]
            low[todo] = np.where(before, middle + 1, low[todo])
            high[todo] = np.where(before, high[todo], middle)
        rank = low - base
        pair = begin[active] + (run[active] // 2) * 2 * width
        place = pair + (within[active] - run[active] * width) + rank
        merged = order.copy()
        merged[place] = order[active]
        order = merged
        width *= 2
    return order


def repeated_starts(data: np.ndarray, offsets: np.ndarray, group: np.ndarray, back: np.ndarray, span: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment, start in it) of every string that another segment of its group holds at the same offset."""
    n_starts = span + 1
    owner = np.repeat(np.arange(len(group)), n_starts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n_starts) - n_starts, n_starts)
    offset = back[owner] - within
    by = np.lexsort((offset, group[owner]))
    key = group[owner][by] * (length + 1) + offset[by]
    alone = np.ones(len(by), bool)
    same = key[1:] == key[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    by, key = by[~alone], key[~alone]
    if not len(by):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = offsets[:-1][owner[by]] + within[by]
    order = sort_suffixes(data, at, key, length)
    x, y = at[order[:-1]], at[order[1:]]
    hashes = prefix_hashes(data)
    near = (key[order[1:]] == key[order[:-1]]) & (stretch_hash(hashes, x, x + length) == stretch_hash(hashes, y, y + length))
    # Equal hashes are not enough: the bytes themselves are compared.
    view, checked = sliding_window_view(data, length), np.flatnonzero(near)
    for i in range(0, len(checked), 4096):
        some = checked[i : i + 4096]
        near[some] = (view[x[some]] == view[y[some]]).all(1)
    hit = np.zeros(len(order), bool)
    hit[1:] |= near
    hit[:-1] |= near
    hit = by[order[hit]]
    return owner[hit], within[hit]


def _sort_groups(length: int):
    """Mapper over segments sorted by anchor: ranges of repeated strings. Takes whole groups, some at a time."""

    def settle(rows: list[tuple]):
        anchor = np.array([r[0] for r in rows], np.int64)
        group = np.cumsum(np.diff(anchor, prepend=anchor[0]) != 0)
        pieces = [r[6] for r in rows]
        data = np.frombuffer(b"".join(pieces), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(p) for p in pieces])))
        back, span = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
        segment, within = repeated_starts(data, offsets, group, back, span, length)
        order = np.lexsort((within, segment))
        segment, within = segment[order], within[order]
        new = np.ones(len(segment), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (within[1:] != within[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(segment)) - 1
        key, size, start = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3))
        own = segment[begin]
        return pa.RecordBatch.from_arrays(
            [pa.array(key[own]), pa.array(size[own], pa.int32()), pa.array(start[own] + within[begin], pa.int32()), pa.array(start[own] + within[end] + length, pa.int32())],
            names=["key", "size", "start", "end"],
        )

    def run(batches):
        rows, suffixes = [], 0
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(7))):
                if suffixes >= _BATCH_SUFFIXES and r[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, suffixes = [], 0
                rows.append(r)
                suffixes += r[5] + 1
        if rows:
            yield settle(rows)

    return run


def _cut(length: int):
    """Mapper from texts with the places of their open segments to the segments' bytes; segments of crowded
    anchors as single strings."""

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            texts, at = [], 0
            for chunk in chunks(batch.column(2)):
                texts += [chunk.slice(r) for r in range(chunk.rows)]
            for key, size, text, places in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, batch.column(3).to_pylist()):
                if (key, size) in seen:  # a copy
                    continue
                seen.add((key, size))
                for p in places:
                    s, back, span = p["start"], p["back"], p["span"]
                    if not p["crowded"]:
                        out.append((p["anchor"], key, size, s, back, span, bytes(text[s : s + span + length])))
                        continue
                    for t in range(span + 1):
                        one = bytes(text[s + t : s + t + length])
                        name = xxhash.xxh3_64_intdigest(one, seed=back - t) ^ (p["anchor"] & (1 << 64) - 1)
                        out.append((name - (1 << 64) if name >> 63 else name, key, size, s + t, back - t, 0, one))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["anchor", "key", "size", "start", "back", "span", "bytes"]
            )

    return run


def repeated_ranges(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, size, start, end): byte ranges of ``texts`` (key, size, text) that repeated strings cover.

    ``key`` and ``size`` stand for the text; equal texts have equal ones. Ranges may overlap.
    """
    mapped = map_stream(texts.select("key", "text"), _map_segments(length, gram), f"{_RESULT}, seal long, twice boolean")
    dealt = mapped.repartition("anchor").sortWithinPartitions("kind", "anchor", "seal")
    settled = stage(map_stream(dealt, _settle, _RESULT), "segments")
    whole = settled.where(F.col("kind") == _WHOLE).select("key", "size", "start", (F.col("start") + F.col("span") + length).alias("end"))
    places = settled.where(F.col("kind") == _OPEN)
    crowd = places.groupBy("anchor").agg((F.count(F.lit(1)) > SEGMENTS_A_TASK).alias("crowded")).where("crowded")
    places = places.join(crowd, "anchor", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    by_text = places.groupBy("key", "size").agg(F.collect_list(F.struct("anchor", "start", "back", "span", "crowded")).alias("places"))
    cut = texts.select("key", "size", "text").join(by_text, ["key", "size"]).select("key", "size", "text", "places")
    cut = map_stream(cut, _cut(length), "anchor long, key long, size int, start int, back int, span int, bytes binary")
    sorted_ = cut.repartition("anchor").sortWithinPartitions("anchor")
    part = stage(map_stream(sorted_, _sort_groups(length), "key long, size int, start int, end int"), "repeats")
    return whole.union(part)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, as_text: bool = False) -> DataFrame:
    """``docs`` with ``kept`` (binary; ``as_text``, a string without characters that were cut in two) and ``removed`` (array of start and end) for every whole text.

    Each byte of a string of ``length`` bytes that also starts elsewhere, in the same text or another, is
    removed; strings never run from one text into the next. NULL texts count as empty, and texts shorter
    than ``length`` stay whole. Rows, copies included, stay rows of their own: a text of ``length`` bytes or
    more that stands in two rows is removed from both. Columns named ``kept`` or ``removed`` are replaced.
    """
    docs = docs.drop("kept", "removed")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(F.xxhash64(text).alias("key"), F.octet_length(text).cast("int").alias("size"), text.alias("text"))
    ranges = repeated_ranges(texts, length, gram)
    merged = ranges.groupBy("key", "size").agg(F.collect_set(F.struct("start", "end")).alias("_ranges"))
    names = docs.columns
    keyed = docs.withColumn("_key", F.xxhash64(text)).withColumn("_size", F.octet_length(text).cast("int"))
    merged = merged.select(F.col("key").alias("_k"), F.col("size").alias("_s"), "_ranges")
    both = keyed.join(merged, (F.col("_key") == F.col("_k")) & (F.col("_size") == F.col("_s")), "left").select(*names, "_ranges")
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("kept", T.StringType() if as_text else T.BinaryType()), T.StructField("removed", spans)])
    at = names.index("text")

    def run(batches):
        for batch in batches:
            texts = [bytes(c.slice(r)) for c in chunks(batch.column(at)) for r in range(c.rows)]
            kept, removed = [], []
            for text, ranges in zip(texts, batch.column(len(names)).to_pylist()):
                spans, rest, last = [], [], 0
                for r in sorted(ranges or [], key=lambda r: (r["start"], r["end"])):
                    if spans and r["start"] <= spans[-1]["end"]:
                        spans[-1]["end"] = max(spans[-1]["end"], r["end"])
                    else:
                        spans.append({"start": r["start"], "end": r["end"]})
                for s in spans:
                    rest.append(text[last : s["start"]])
                    last = s["end"]
                left = b"".join([*rest, text[last:]])
                kept.append(left.decode(errors="ignore") if as_text else left)
                removed.append(spans)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(kept, pa.string() if as_text else pa.binary()), pa.array(removed, kind)], names=schema.names
            )

    return map_stream(both, run, schema)

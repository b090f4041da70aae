"""Language-model scores by a probabilistic suffix tree over words.

The tree's nodes are contexts, the one or more words before a symbol. A context that occurs twice or more keeps the
next words that follow it twice or more; it is retained if the plain frequencies of these words diverge enough from
those behind its longest retained suffix. A word is predicted by the longest context in the tree. What a context has
kept is discounted, and the freed mass follows the shorter context, down to word frequencies with half a count added.

Longer contexts are looked at only where they can still be retained. What a longer context may gain on a word is at
most what the word costs now, so a context whose words are all predicted well enough is closed with everything that
ends in it, which loses no context. Contexts of one to three words are counted over the corpus, longer ones as long
as one is too frequent for a task; the occurrences of what is open then are dealt out with some words before each,
and tasks grow their subtrees word by word. What is still open at the end of these words is dealt out again with more
words, until nothing is open. Long contexts are dealt out by an anchor, a short run chosen from their words alone, so
that neighbouring contexts of a passage mostly share one and the passage is sent once for all of them.

The tree grows with the corpus, so it is a table of Spark. A text's score is the sum, over all its runs of words, of
what each run adds: the factor of a retained context, and for a kept next word what it has above the shorter context.
Only runs behind open contexts can add anything; texts look them up in the table by ranges of the runs' hashes. Words
and runs that are most frequent are sent to the tasks instead, a bounded number, which changes no score.
"""

from __future__ import annotations

import contextlib
import functools
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.text import INVERSE, Chunk, chunks, map_stream, mix, packed, positions, powers, unpacked, words
from tidemill.session import stage, unstage

DEPTH = 2
# The fewest occurrences of a context, and of a next word behind it.
LEAST = 2
# Words of this share of the training tokens, and at most so many runs, are looked up within tasks, others by a join.
SENT_SHARE = 1e-6
SENT_RUNS = 1_000_000
# Slices, a power of two, in which rare words and runs are looked up one after another, so that less stands on disk at once.
SLICES = 8
# Bits a word by which a context's distribution must differ from that of its suffix.
DIVERGENCE = 0.02
DISCOUNT = 0.5
# Words before an occurrence that are dealt out with it at first, and how many times as many in every further round.
BEFORE, FURTHER = 16, 8
# Words of the run by which longer contexts are dealt out.
ANCHOR = 8
# Occurrences up to which a context is grown in a task, and occurrences that a task grows at once.
GROUP = 500_000
_GROWN = 100_000

# The symbol behind every text.
_END = mix(np.array([0xE9D], np.uint64))[0]
_LENGTH = np.uint64(0xD1B54A32D192ED03)
# Bytes of text that a task counts at once, and entries it keeps before it sums them up or hands them on.
_CHUNK = 1 << 19
_HELD = 1_000_000
# Words up to which the runs of a text are looked up length by length.
_EACH = 12
# The most bits, as a power of two, of a sieve.
_SIEVE_BITS = 28


@contextlib.contextmanager
def _rows_of_numbers(spark):
    """While rows of a few numbers go to tasks, batches are bounded in rows alone: looking at their bytes takes several
    times as long as handing them over."""
    settings = {f"spark.sql.execution.arrow.{k}": v for k, v in (("maxRecordsPerBatch", "20000"), ("maxBytesPerBatch", str((1 << 31) - 1)))}
    before = {key: spark.conf.get(key) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def _batched(batches):
    """The hashes of a column, up to ``_HELD`` at a time."""
    parts, held = [], 0
    for batch in batches:
        if batch.num_rows:
            parts.append(batch.column(0).to_numpy().view(np.uint64))
            held += len(parts[-1])
        if held > _HELD:
            yield np.concatenate(parts)
            parts, held = [], 0
    if parts:
        yield np.concatenate(parts)


class Sieve:
    """Bits of the hashes of a table, three of one word for each: it lets through all of them and about one in a hundred
    others. Its size is bounded; beyond about 1e8 hashes it lets through most others too, which costs time and changes
    no result."""

    def __init__(self, keys: DataFrame, n: int | None = None, batched=_batched):
        """Of the column ``key``, or of what ``batched`` gives of the ``n`` keys in other rows."""
        n = keys.count() if n is None else n
        self.bits = bits = min(_SIEVE_BITS, max(10, ((64 if n < 1 << 18 else 16) * n).bit_length()))

        places = self._places

        def pieces(batches):
            """(range, data): the words of a task's bits that are not 0, by 32 ranges."""
            for key in filter(len, batched(batches)):
                word, value = places(key, bits)
                order, new = _equal(word)
                value = np.bitwise_or.reduceat(value[order], new)
                word = word[order[new]]
                of = word >> max(0, bits - 11)
                bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                data = [np.array([b - a], np.int64).tobytes() + packed(word[a:b]) + packed(value[a:b]) for a, b in zip(bounds, [*bounds[1:], len(of)])]
                yield pa.RecordBatch.from_arrays([pa.array(of[bounds]), pa.array(data, pa.binary())], names=["range", "data"])

        def united(batches):
            found: dict[int, np.ndarray] = {}
            each = 1 << max(0, bits - 11)
            for batch in batches:
                for of, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    (size,) = np.frombuffer(data, np.int64, 1).tolist()
                    word, at = unpacked(data, 8, size)
                    value, _ = unpacked(data, at, size)
                    found.setdefault(of, np.zeros(each, np.uint64))[word.astype(np.int64) - of * each] |= value.astype(np.uint64)
            if found:
                data = [packed(x) for x in found.values()]
                yield pa.RecordBatch.from_arrays([pa.array([*found]), pa.array(data, pa.binary())], names=["range", "data"])

        kind, each = "range long, data binary", 1 << max(0, bits - 11)
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        if n:
            with _rows_of_numbers(keys.sparkSession) if batched is _batched else contextlib.nullcontext():
                table = map_stream(map_stream(keys, pieces, kind).repartition("range"), united, kind).toArrow()
            for of, data in zip(table.column("range").to_pylist(), table.column("data").to_pylist()):
                self.words[of * each : (of + 1) * each] = unpacked(data, 0, each)[0]

    @staticmethod
    def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The word of each key, and its bits there."""
        one, last = np.uint64(1), np.uint64(63)
        value = (one << (keys >> np.uint64(58))) | (one << (keys >> np.uint64(52) & last)) | (one << (keys >> np.uint64(46) & last))
        return (keys & np.uint64((1 << (bits - 6)) - 1)).astype(np.int64), value

    def lets_through(self, keys: np.ndarray) -> np.ndarray:
        word, value = self._places(keys, self.bits)
        return self.words[word] & value == value


@dataclass
class Tree:
    """Frequent words (sorted hashes) with their counts, and the table (range, data) of what runs of one to ``longest``
    words add to a score, which ``_tree_rows`` reads: their keys, how often they occur and what they add, and the keys of
    open contexts. A run may have a row as a context and one as a next word behind its context, which add up; both
    occur equally often. ``depth`` is the length of the longest retained context."""

    total: int
    vocabulary: int
    words: np.ndarray
    counts: np.ndarray
    runs: DataFrame
    longest: int = 0
    depth: int = 0

    def base(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the base probability of words counted so often."""
        return np.log10((counts + 0.5) / (self.total + 0.5 * (self.vocabulary + 1)))


@dataclass
class _Limits:
    """What a context and a next word need to be kept."""

    context: int
    follow: int
    divergence: float


@dataclass
class _Sent:
    """What every scoring task gets: frequent words with their base terms, frequent runs with what they add, the
    sieve of all runs that add something, and that of open contexts."""

    words: np.ndarray
    base: np.ndarray
    runs: np.ndarray
    values: np.ndarray
    adding: Sieve
    opened: Sieve
    longest: int


def _tokens(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every token, each row's end symbol included, and the first token of every row."""
    found = words(chunk)
    n = chunk.rows
    first = found.first + np.arange(n + 1)
    row = np.repeat(np.arange(n), np.diff(first))
    token = np.full(first[-1], _END, np.uint64)
    token[np.arange(len(found.hash)) + found.row] = found.hash
    return token, row, first


class _Runs:
    """Hashes of the runs of words in a sequence of tokens; a single word's is its own."""

    def __init__(self, token: np.ndarray):
        self.token = token
        self.sums = np.zeros(len(token) + 1, np.uint64)
        np.cumsum(token * powers(len(token)), out=self.sums[1:])
        self.inverse = powers(len(token) + 1, INVERSE)

    def keys(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        """The hashes of runs of ``length`` words, one number or, from two words on, a number for each."""
        if np.ndim(length) == 0 and length == 1:
            return self.token[start]
        raw = (self.sums[start + length] - self.sums[start]) * self.inverse[start]
        return mix(raw + _LENGTH * np.asarray(length).astype(np.uint64))


def _anchors(runs: _Runs, start: np.ndarray, length: int) -> np.ndarray:
    """Where the anchors of runs of ``length`` words begin: of their runs of ``ANCHOR`` words the one with the smallest
    mixed hash, the last of equal ones. Equal runs have equal anchors at the same place."""
    gram = min(length, ANCHOR)
    rank = mix(runs.keys(np.arange(len(runs.token) - gram + 1), gram))
    # The best of 1, 2, 4, ... neighbours; two such stretches cover a run.
    best, step, span = np.arange(len(rank)), 1, length - gram + 1
    while 2 * step <= span:
        left, right = best[:-step], best[step:]
        best, step = np.where(rank[right] <= rank[left], right, left), 2 * step
    left, right = best[start], best[start + span - step]
    return np.where(rank[right] <= rank[left], right, left)


def _range_bits(total: int) -> int:
    """Bits of a hash by which work is dealt out, for about a million tokens each."""
    return max(5, min(20, int(total >> 20).bit_length()))


def _path_keys(paths: np.ndarray) -> np.ndarray:
    """The hashes of runs given word by word."""
    length = paths.shape[1]
    if length == 1:
        return paths[:, 0]
    raw = sum(paths[:, j] * weight for j, weight in enumerate(powers(length)))
    return mix(raw + _LENGTH * np.uint64(length))


def _packed_words(word: np.ndarray, common=None) -> bytes:
    """Hashes of words, few of them different, as numbers into the list of those, of which the ``common`` ones (sorted,
    broadcast) are numbers too."""
    symbols, at = np.unique(word, return_inverse=True)
    place = positions(common.value, symbols) if common is not None else np.full(len(symbols), -1)
    rare = place < 0
    number, place = np.cumsum(rare) - 1, place[~rare]
    number[~rare] = len(symbols) - len(place) + np.arange(len(place))
    sizes = np.array([len(symbols) - len(place), len(place), len(word)], np.int64).tobytes()
    return sizes + packed(symbols[rare]) + packed(np.diff(place, prepend=0)) + packed(number[at])


def _unpacked_words(data: bytes, at: int, common=None) -> tuple[np.ndarray, int]:
    n, m, length = np.frombuffer(data, np.int64, 3, at).tolist()
    symbols, at = unpacked(data, at + 24, n)
    place, at = unpacked(data, at, m)
    index, at = unpacked(data, at, length)
    if m:
        symbols = np.append(symbols.astype(np.uint64), common.value[np.cumsum(place.astype(np.int64))])
    return symbols.astype(np.uint64)[index], at


def _equal(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts keys, and where in it each distinct key begins. Unlike ``np.unique`` with places it need not
    be stable, which takes a fifth of the time."""
    order = np.argsort(key)
    ordered = key[order]
    return order, np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(key)])


def _numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct key, in the order of keys, and by place the number of its key."""
    order, begin = _equal(key)
    number = np.empty(len(key), np.int64)
    number[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
    return order[begin], number


def _distinct(key: np.ndarray, columns: list[np.ndarray], n: np.ndarray | None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys, sorted, with what any entry has in ``columns`` and how often they occur."""
    order, begin = _equal(key)
    one = order[begin]
    n = np.diff(np.append(begin, len(key))) if n is None else np.add.reduceat(n[order], begin)
    return key[one], [c[one] for c in columns], n.astype(np.int64)


def _merged(parts: list[tuple]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """One part of several from ``_distinct``, which are emptied: a column at a time, so that little is held twice."""
    if len(parts) == 1:
        return parts[0]
    key = np.concatenate([p[0] for p in parts])
    order, begin = _equal(key)
    n = np.add.reduceat(np.concatenate([p[2] for p in parts])[order], begin)
    one = order[begin]
    key = key[one]
    del order, begin
    columns = []
    while parts[0][1]:
        columns.append(np.concatenate([p[1].pop() for p in parts])[one])
    return key, columns[::-1], n


def _tallied(found):
    """Parts from ``_distinct`` summed up: some large ones, never much more than ``_HELD`` entries held at once."""
    parts, held = [], 0
    for part in found:
        parts.append(part)
        held += len(part[0])
        if held > _HELD:
            parts = [_merged(parts)]
            held = len(parts[0][0])
            # Where little is equal, summing up again would bring little.
            if held > 3 * _HELD // 4:
                yield parts.pop()
                held = 0
    if parts:
        yield _merged(parts)


def _count(texts: DataFrame, length: int, ends_of, bits: int, common=None, by_context: bool = False) -> DataFrame:
    """(range, data): how often runs of ``length`` words occur in each task's share, by ranges of their hashes, or of
    those of the words before the last, so that all runs of a context are in one range.

    ``ends_of(chunk)`` gives the tokens, the places of the runs' last words, and whether those words are to be told
    apart. Rows are few and large: what tasks hand on is summed up in tasks again."""

    def found(batches):
        for batch in batches:
            for chunk in chunks(batch.column(0), _CHUNK):
                token, end, apart = ends_of(chunk)
                if len(end):
                    paths = [token[end - back] for back in range(length - 1, -1, -1)]
                    paths[-1][~apart] = 0
                    key = mix(_path_keys(np.stack(paths, axis=1)))
                    if by_context:
                        key = key >> np.uint64(bits) | _path_keys(np.stack(paths[:-1], axis=1)) >> np.uint64(64 - bits) << np.uint64(64 - bits)
                    yield _distinct(key, paths, None)

    def run(batches):
        for key, paths, n in _tallied(found(batches)):
            # Keys are sorted, so ranges are too.
            of = (key >> np.uint64(64 - bits)).astype(np.int64)
            bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            data = [_packed_words(np.concatenate([p[a:b] for p in paths]), common) + packed(n[a:b]) for a, b in zip(bounds, [*bounds[1:], len(of)])]
            yield pa.RecordBatch.from_arrays([pa.array(of[bounds]), pa.array(data, pa.binary())], names=["range", "data"])

    return map_stream(texts.select("text"), run, "range long, data binary")


def _united(counted: DataFrame, length: int, least: float, totals: bool, common=None) -> DataFrame:
    """(key, context, suffix, n) of the runs that occur ``least`` times in all, from ``_count``. With ``totals``, where
    they are dealt out by context, also what all runs of each such context have together, those that are not told apart
    included, without a key."""

    def rows(parts):
        paths, n = (np.concatenate(x) for x in zip(*parts))
        key = _path_keys(paths)
        order, begin = _equal(key)
        one, n = order[begin], np.add.reduceat(n[order], begin)
        key, paths = key[one], paths[one]
        context = _path_keys(paths[:, :-1])
        kept = (n >= least) & (paths[:, -1] != 0)
        columns = [key[kept], context[kept], _path_keys(paths[:, 1:])[kept]]
        yield pa.RecordBatch.from_arrays([*(pa.array(c.view(np.int64)) for c in columns), pa.array(n[kept])], names=["key", "context", "suffix", "n"])
        if totals:
            # Of contexts with such a run only; all that follows a context is in its range.
            context, back = np.unique(context, return_inverse=True)
            n = np.bincount(back, n, len(context)).astype(np.int64)
            some = np.bincount(back[kept], minlength=len(context)) > 0
            context, n = pa.array(context[some].view(np.int64)), pa.array(n[some])
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([none, context, none, n], names=["key", "context", "suffix", "n"])

    def counted_in(data):
        word, place = _unpacked_words(data, 0, common)
        n, _ = unpacked(data, place, len(word) // length)
        return word.reshape(length, -1).T, n.astype(np.int64)

    def run(batches):
        for parts in _by_range(batches):
            yield from rows([counted_in(x) for x in parts])

    dealt = counted.repartition("range").sortWithinPartitions("range")
    return map_stream(dealt, run, "key long, context long, suffix long, n long")


def _collected(df: DataFrame, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys as unsigned hashes, sorted, and a column, summed up by key; the caller has bounded their number."""
    table = df.select("key", column).toArrow()
    key, value = (table.column(c).to_numpy() for c in ("key", column))
    order, begin = _equal(key.view(np.uint64))
    return key.view(np.uint64)[order[begin]], np.add.reduceat(value[order], begin).astype(np.float64)


def _by_range(batches):
    """What stands in ``data`` for each range, from rows (range, data) sorted by it."""
    current, parts = None, []
    for batch in batches:
        for of, data in zip(batch.column(0).to_pylist(), batch.column(1)):
            if of != current and parts:
                yield parts
                parts = []
            current = of
            parts.append(data.as_buffer().to_pybytes())
    if parts:
        yield parts


def _word_counts(texts: DataFrame) -> DataFrame:
    """(key, n) of all words, summed up within a task first, then by 256 ranges of their hashes."""

    def found(batches):
        for batch in batches:
            for chunk in chunks(batch.column(0), _CHUNK):
                yield _distinct(_tokens(chunk)[0], [], None)

    def run(batches):
        for key, _, n in _tallied(found(batches)):
            of = (key >> np.uint64(56)).astype(np.int64)
            bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            data = [np.array([b - a], np.int64).tobytes() + packed(key[a:b]) + packed(n[a:b]) for a, b in zip(bounds, [*bounds[1:], len(of)])]
            yield pa.RecordBatch.from_arrays([pa.array(of[bounds]), pa.array(data, pa.binary())], names=["range", "data"])

    def counted(data):
        (size,) = np.frombuffer(data, np.int64, 1).tolist()
        key, at = unpacked(data, 8, size)
        return key.astype(np.uint64), [], unpacked(data, at, size)[0].astype(np.int64)

    def united(batches):
        for parts in _by_range(batches):
            key, _, n = _merged([counted(x) for x in parts])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    dealt = map_stream(texts.select("text"), run, "range long, data binary").repartition("range").sortWithinPartitions("range")
    return map_stream(dealt, united, "key long, n long")


def train(texts: DataFrame, depth: int | None = DEPTH, context_share: float = 0.0, follow_share: float = 0.0, divergence: float = DIVERGENCE) -> tuple[Tree, DataFrame]:
    """The tree, and the staged counts (key, n) of all words, from every one of ``texts``.

    ``depth`` is 1 or 2 words, or None for as many as there are contexts that diverge. A context must occur
    ``LEAST`` times and a next word behind it too; shares of the training tokens above 0 ask for more. It is retained
    if the bits that its plain frequencies save on its kept words, against those of its longest retained suffix, are
    ``divergence`` for each of its occurrences and pay for writing the frequencies down. No texts give a tree without
    words, by which every token has the same probability.
    """
    if depth not in (1, 2, None):
        raise ValueError("contexts have one or two words")
    counts = stage(_word_counts(texts), "words")
    total, vocabulary, *sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1)), *(F.count_if(F.col("n") >= F.lit(1 << size)) for size in range(1, 41))).first()
    # The most frequent words, by powers of two, go as numbers where words are dealt out.
    common = _collected(counts.where(F.col("n") >= F.lit(next((2 << i for i, many in enumerate(sizes) if many <= SENT_RUNS), 1 << 62))), "n")[0]
    common = texts.sparkSession.sparkContext.broadcast(common)
    limits = _Limits(max(LEAST, context_share * total), max(LEAST, follow_share * total), divergence)
    # At most 1 / SENT_SHARE words.
    key, n = _collected(counts.where(F.col("n") >= F.lit(max(SENT_SHARE, follow_share) * total)), "n")
    tree = Tree(int(total), int(vocabulary), key, n, counts)
    base = F.log10((F.col("n") + 0.5) / F.lit(total + 0.5 * (vocabulary + 1)))
    # Runs that are kept behind open contexts: how often they occur, log10 of the probability of their last word behind
    # the others, and log2 of its plain frequency behind the longest retained suffix.
    known = counts.where(F.col("n") >= F.lit(limits.follow)).select("key", "n", base.alias("log"), F.log2(F.col("n") / F.lit(max(total, 1))).alias("q"))
    of = counts.select(F.col("key").alias("context"), F.col("n").alias("of"))
    bits = _range_bits(total)
    parts, staged, length, opened, doubles, many = [], [], 0, None, None, (None, None)
    while depth is None or length < depth:
        length += 1
        ends, sieves = _ends(texts, length, known, opened, doubles, many)
        counted = _count(texts, length + 1, ends, bits, common, by_context=length > 2)
        # Written before it is joined: what the counting tasks handed on need not stand on disk beside the joins.
        follow = stage(_united(counted, length + 1, limits.follow, totals=length > 2, common=common), "counted")
        # What is sent along stands on the disk of every machine.
        for sieve in sieves:
            sieve.destroy()
        rows = _fit(follow, of if length <= 2 else None, known, limits, every=length == 1)
        unstage(follow)
        staged.append(rows)
        parts.append(_packed(rows.where("node OR value IS NOT NULL").select("key", "n", "value", F.expr("node AND open").alias("open")), bits))
        if len(staged) > 1:
            # Only the last level is read again.
            unstage(staged.pop(0))
        kept, contexts = rows.where("NOT node"), rows.where("node")
        opened = contexts.where("open")
        known = kept.where("open").select("key", "context", "n", "log", "q")
        node, is_open = F.col("node"), F.col("open")
        counted = (F.count_if(x) for x in (node & F.col("value").isNotNull(), ~node & is_open, node & is_open, ~node))
        largest, retained, *many, pairs = rows.agg(F.max(F.when(node & is_open, F.col("n"))), *counted).first()
        if length == 1:
            # Every pair of words that occurs twice is a context of two words, whatever the first predicts.
            of = kept.select(F.col("key").alias("context"), F.col("n").alias("of"))
            doubles = texts.sparkSession.sparkContext.broadcast(Sieve(kept.select("key"), pairs))
        if retained:
            tree.depth, tree.longest = length, length + 1
        if largest is None or (length >= 3 and largest <= GROUP):
            break
    doubles.destroy()
    if depth is None and largest is not None:
        grown = _grow_all(texts, known, opened, length, limits, tree, common)
        grown_rows = [rows.where("NOT known").select("key", "n", "value", "open") for rows in grown]
        parts.append(_packed(functools.reduce(DataFrame.union, grown_rows), bits))
        staged += grown
    tree.runs = functools.reduce(DataFrame.union, parts)
    for rows in staged:
        unstage(rows)
    common.destroy()
    return tree, counts


def _ends(texts: DataFrame, length: int, known: DataFrame, opened: DataFrame | None, doubles, many: tuple[int | None, int | None]):
    """By chunk, the last words of the runs of a context of ``length`` words and a next word that have to be counted,
    and which of them can be kept; and the sieves sent along for it, of ``many`` known runs and open contexts.

    The context without its first word must be open, and its first two words occur as often as a context has to
    (``doubles``). A run is kept only if it is without its first word; of contexts of three and more words, whose own
    counts are not known, the others are counted too."""
    context = texts.sparkSession.sparkContext
    kept = context.broadcast(Sieve(known.select("key"), many[0]))
    sieve = context.broadcast(Sieve(opened.select("key"), many[1])) if opened is not None else None

    def ends(chunk: Chunk):
        token, row, first = _tokens(chunk)
        runs = _Runs(token)
        at = np.arange(len(token))
        at = at[at - first[row] >= length]
        if length == 1:
            at = at[kept.value.lets_through(token[at - 1])]
        else:
            at = at[sieve.value.lets_through(runs.keys(at - length + 1, length - 1))]
            at = at[doubles.value.lets_through(runs.keys(at - length, 2))]
        apart = kept.value.lets_through(runs.keys(at - length + 1, length))
        if length < 3:
            at, apart = at[apart], apart[apart]
        return token, at, apart

    return ends, [x for x in (kept, sieve) if x is not None]


def _least_cost(n):
    """Bits for writing down one frequency of a context with ``n`` occurrences."""
    return np.log2(n + 1.0) / 2


def _fit(follow: DataFrame, of: DataFrame | None, shorter: DataFrame, limits: _Limits, every: bool) -> DataFrame:
    """The kept runs (key, context, n, log, q, value, open) of contexts that are retained or open, or of ``every``
    context, and as rows with ``node`` the contexts (key, n, value, open) that are retained or open; ``value`` is NULL
    where nothing is retained. ``of`` has how often contexts occur, or else ``follow`` has rows without a key for that;
    ``shorter`` are the kept runs without their first word."""
    shorter = shorter.select(F.col("key").alias("suffix"), "log", "q").hint("shuffle_hash")
    if of is None:
        of = follow.where("key IS NULL").select("context", F.col("n").alias("of"))
    found = follow.where("key IS NOT NULL").join(shorter, "suffix").select("context", "key", "n", "log", "q")
    none = (F.lit(None).cast("double").alias(c) for c in ("log", "q"))
    found = found.union(of.select("context", F.lit(None).cast("long").alias("key"), F.col("of").alias("n"), *none))
    dealt = found.repartition("context").sortWithinPartitions("context")
    with _rows_of_numbers(dealt.sparkSession):
        return stage(map_stream(dealt, _judged(limits, every), _FIT), "runs")


_FIT = "key long, context long, n long, log double, q double, value double, open boolean, node boolean"


class _Held:
    """Batches that are read several times; more than ``_HELD`` rows, those of a frequent context, wait in a file."""

    def __init__(self):
        self.batches, self.rows, self.waiting, self.last, self.file = [], 0, 0, None, None

    def add(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)
        self.rows, self.waiting, self.last = self.rows + batch.num_rows, self.waiting + batch.num_rows, batch.column(0)[-1].as_py()
        if self.waiting > _HELD:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
                self.stream = pa.ipc.new_stream(self.file, batch.schema)
            self.stream.write_table(pa.Table.from_batches(self.batches), max_chunksize=_HELD // 8)
            self.batches, self.waiting = [], 0

    def tables(self):
        """Columns of rows, a part at a time."""
        if self.file is not None:
            self.stream.close()
            self.file.seek(0)
            for batch in pa.ipc.open_stream(self.file):
                yield self._columns(pa.Table.from_batches([batch]))
        if self.batches:
            yield self._columns(pa.Table.from_batches(self.batches))

    @staticmethod
    def _columns(table: pa.Table) -> tuple[np.ndarray, ...]:
        context, key, n, log, q = (table.column(c) for c in ("context", "key", "n", "log", "q"))
        total = key.is_null().to_numpy()
        return context.to_numpy(), total, key.fill_null(0).to_numpy(), n.to_numpy(), *(x.fill_null(0.0).to_numpy() for x in (log, q))


def _whole(batches):
    """Rows sorted by their context as ``_Held`` of whole contexts."""
    held, piece = _Held(), _HELD // 4
    for batch in batches:
        if not batch.num_rows:
            continue
        context = batch.column(0).to_numpy()
        if held.rows >= piece and context[0] != held.last:
            yield held
            held = _Held()
        cut = int(np.searchsorted(context, context[-1])) if held.rows + len(context) >= piece else 0
        if cut:
            held.add(batch.slice(0, cut))
            yield held
            held, batch = _Held(), batch.slice(cut)
        held.add(batch)
    if held.rows:
        yield held


def _sums(of: np.ndarray, m: np.ndarray, n: np.ndarray, log: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """Of kept next words of the contexts ``of``, which occur ``n`` times, by context: their number, discounted mass, mass
    behind the shorter context and bits saved; then the most that a word behind a longer context can save, a word and
    above its cost, at plain frequencies and at those behind the shorter context."""
    plain = np.log2(m / n[of])
    out = [np.bincount(of, x, len(n)) for x in (None, (m - DISCOUNT) / n[of], 10.0**log, m * (plain - q))]
    cost = _least_cost(m)
    for bits in (plain, q):
        for hope in (-bits, -bits * m - cost):
            out.append(np.full(len(n), -np.inf))
            np.maximum.at(out[-1], of, hope)
    return out


def _decided(sums: list[np.ndarray], n: np.ndarray, limits: _Limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which contexts are retained, log10 of the factor of what they have not kept, and which are open."""
    kept, mass, parent, saved, *hope = sums
    retained = (kept > 0) & (saved >= limits.divergence * n) & (saved >= kept * _least_cost(n))
    backoff = np.log10(np.maximum(1 - mass, 1e-9) / (1 - np.minimum(parent, 1 - 1e-9)))
    word, above = (np.where(retained, hope[i], hope[i + 2]) for i in (0, 1))
    return retained, backoff, (word >= limits.divergence) & (above >= 0)


def _values(of: np.ndarray, m: np.ndarray, n: np.ndarray, log: np.ndarray, q: np.ndarray, retained: np.ndarray, backoff: np.ndarray):
    """Whose context is retained, what they add to a score then, and log10 of the probability and log2 of the plain
    frequency of kept next words behind their longest retained context."""
    there, p = retained[of], np.log10((m - DISCOUNT) / n[of])
    return there, p - log - backoff[of], np.where(there, p, log), np.where(there, np.log2(m / n[of]), q)


def _judged(limits: _Limits, every: bool):
    """By batches of (context, key, n, log, q) sorted by context, how often it occurs in rows without a key: ``_FIT``."""

    def judged(held):
        contexts = np.unique(np.concatenate([context[np.append(True, context[1:] != context[:-1])] for context, *_ in held.tables()]))
        n = np.zeros(len(contexts))
        for context, total, _, m, *_ in held.tables():
            n += np.bincount(np.searchsorted(contexts, context[total]), m[total], len(n))
        sums = None

        def kept():
            for context, total, key, m, log, q in held.tables():
                of = np.searchsorted(contexts, context)
                stays = ~total & (n >= limits.context)[of]
                yield of[stays], *(x[stays] for x in (context, key, m, log, q))

        for of, _, _, m, log, q in kept():
            more = _sums(of, m, n, log, q)
            sums = more if sums is None else [(np.add if i < 4 else np.maximum)(a, b) for i, (a, b) in enumerate(zip(sums, more))]
        retained, backoff, opened = _decided(sums, n, limits)
        for of, context, key, m, log, q in kept():
            there, value, log, q = _values(of, m, n, log, q, retained, backoff)
            rows = np.arange(len(of)) if every else np.flatnonzero(there | opened[of])
            arrays = [pa.array(x[rows]) for x in (key, context, m, log, q)]
            yield _fit_batch(*arrays, pa.array(value[rows], mask=~there[rows]), pa.array(opened[of][rows]), False)
        rows = np.flatnonzero(retained | opened)
        key, none = pa.array(contexts[rows]), pa.nulls(len(rows), pa.float64())
        yield _fit_batch(key, pa.nulls(len(rows), pa.int64()), pa.array(n[rows].astype(np.int64)), none, none, pa.array(backoff[rows], mask=~retained[rows]), pa.array(opened[rows]), True)

    def run(batches):
        for held in _whole(batches):
            yield from judged(held)

    return run


def _fit_batch(*columns) -> pa.RecordBatch:
    *columns, node = columns
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(columns[0]), node))], names=[x.split()[0] for x in _FIT.split(", ")])


def _sent_along(texts: DataFrame, opened):
    """The sieve of open contexts, if it is not there already, for all tasks."""
    return texts.sparkSession.sparkContext.broadcast(Sieve(opened.select("key"))) if isinstance(opened, DataFrame) else opened


def _narrowed(texts: DataFrame, opened, length: int) -> DataFrame:
    """The texts with an open context of ``length`` words; only they can have longer ones. ``near`` is the smallest
    hash of a text's open contexts, which near copies mostly share."""
    sieve = _sent_along(texts, opened)

    def run(batches):
        for batch in batches:
            near = np.full(batch.num_rows, np.iinfo(np.uint64).max)
            for chunk in chunks(batch.column(0)):
                token, row, first = _tokens(chunk)
                at = np.arange(len(token))
                at = at[at - first[row] > length]
                context = _Runs(token).keys(at - length, length)
                passes = sieve.value.lets_through(context)
                np.minimum.at(near, chunk.first + row[at[passes]], context[passes])
            stays = np.flatnonzero(near < np.iinfo(np.uint64).max)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(stays)), pa.array(near[stays].view(np.int64))], names=["text", "near"])

    return map_stream(texts.select("text"), run, "text string, near long")


def _gathered(texts: DataFrame, opened, length: int, before: int, bits: int, common=None) -> DataFrame:
    """(range, data): for the open contexts of ``length`` words, by ranges of their anchors' hashes, stretches of texts
    with all occurrences: the places of the next words, each with ``before`` words or the whole beginning of its text.
    Of places with equal words as far as that one is sent, with their number."""
    sieve = _sent_along(texts, opened)

    def stretches(chunk: Chunk):
        token, row, first = _tokens(chunk)
        runs = _Runs(token)
        at = np.arange(len(token))
        at = at[at - first[row] > length]
        at = at[sieve.value.lets_through(runs.keys(at - length, length))]
        at, times = _alike(runs, at, np.maximum(first[row[at]], at - length - before), np.ones(len(at), np.int64))
        anchor = runs.keys(_anchors(runs, at - length, length), min(length, ANCHOR)) if len(at) else token[:0]
        order = np.argsort(anchor, kind="stable")
        at, times, anchor = at[order], times[order], anchor[order]
        # Occurrences near each other share a stretch.
        new = np.ones(len(at), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (row[at[1:]] != row[at[:-1]]) | (at[1:] - at[:-1] > before)
        starts = np.flatnonzero(new)
        often = np.diff(np.append(starts, len(at)))
        begin = np.maximum(first[row[at[starts]]], at[starts] - length - before)
        lengths = at[starts + often - 1] + 1 - begin
        offsets = np.append(0, np.cumsum(lengths))
        words = token[np.repeat(begin - offsets[:-1], lengths) + np.arange(offsets[-1])]
        return anchor[starts], often, lengths, at - np.repeat(begin, often), times, words

    def ranged(parts):
        anchor, often, lengths, places, times, words = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(anchor, kind="stable")
        of = (anchor[order] >> np.uint64(64 - bits)).astype(np.int64)
        bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        word_at, place_at = np.append(0, np.cumsum(lengths)), np.append(0, np.cumsum(often))

        def picked(values, starts, sizes, rows):
            total = sizes[rows]
            offsets = np.append(0, np.cumsum(total))
            return values[np.repeat(starts[rows] - offsets[:-1], total) + np.arange(offsets[-1])]

        data = []
        for a, b in zip(bounds, [*bounds[1:], len(of)]):
            rows = order[a:b]
            numbers = [anchor[rows], often[rows], lengths[rows], *(picked(x, place_at, often, rows) for x in (places, times))]
            data.append(np.array([len(rows), often[rows].sum()], np.int64).tobytes() + b"".join(map(packed, numbers)) + _packed_words(picked(words, word_at, lengths, rows), common))
        return pa.RecordBatch.from_arrays([pa.array(of[bounds]), pa.array(data, pa.binary())], names=["range", "data"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            for chunk in chunks(batch.column(0), _CHUNK):
                found = stretches(chunk)
                if len(found[0]):
                    parts.append(found)
                    held += len(found[-1])
                if held > _HELD:
                    yield ranged(parts)
                    parts, held = [], 0
        if parts:
            yield ranged(parts)

    return map_stream(texts.select("text"), run, "range long, data binary")


def _alike(runs: _Runs, at: np.ndarray, reach: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of all places with equal words from ``reach`` on, in their order, and how many there are."""
    order, begin = _equal(runs.keys(reach, at + 1 - reach))
    one, times = order[begin], np.add.reduceat(times[order], begin)
    order = np.argsort(one)
    return at[one[order]], times[order]


def _stretches_of(data: bytes, common=None) -> tuple[np.ndarray, ...]:
    """Anchors of stretches, how many occurrences and words they have, how many places; these and how many occurrences
    each stands for; and the words."""
    rows, n = np.frombuffer(data, np.int64, 2).tolist()
    out, at = [], 16
    for size in (rows, rows, rows, n, n):
        values, at = unpacked(data, at, size)
        out.append(values)
    words, _ = _unpacked_words(data, at, common)
    often, lengths, places, times = (x.astype(np.int64) for x in out[1:])
    return out[0].astype(np.uint64), np.add.reduceat(times, np.cumsum(often) - often), lengths, often, places, times, words


_GROWTH = "known boolean, anchor long, context long, key long, n long, value double, open boolean, log double, q double, length int"


def _grow(known: tuple, runs: _Runs, word: np.ndarray, next_at: np.ndarray, limit: np.ndarray, times: np.ndarray, length: int, before: int, limits: _Limits):
    """Rows of the subtrees of some open contexts of ``length`` words, from all their occurrences: the places of the
    next words, the beginnings of their texts or stretches, and how many occurrences each of them stands for, with the
    tokens' hashes (``runs``) and numbers. First
    the tree's rows, and at last the kept runs of what is open still (``known``).

    Occurrences are in groups, their contexts, and in pairs, a context and a next word. Most of a group has the same
    word before it, and only what has another is sorted into new groups."""
    n_words = int(word.max()) + 1
    _, group = _numbered(runs.keys(next_at - length, length))
    first, pair = _numbered(group * np.int64(n_words) + word[next_at])
    # Runs that are not kept behind the shorter context are none behind longer ones.
    keys, log, q = known
    place = positions(keys, runs.keys(next_at[first] - length, length + 1))
    log, q = np.where(place >= 0, log[place], np.nan), np.where(place >= 0, q[place], np.nan)
    of = group[first]

    def only(stays):
        """The occurrences in some of the groups, and these alone."""
        nonlocal next_at, limit, times, group, pair, of, log, q
        inside, pairs = stays[group], stays[of]
        next_at, limit, times, group, pair = next_at[inside], limit[inside], times[inside], (np.cumsum(stays) - 1)[group[inside]], (np.cumsum(pairs) - 1)[pair[inside]]
        of, log, q = (np.cumsum(stays) - 1)[of[pairs]], log[pairs], q[pairs]

    for k in range(length + 1, length + before + 1):
        inside = next_at - k >= limit
        if not inside.all():
            next_at, limit, times, group, pair = next_at[inside], limit[inside], times[inside], group[inside], pair[inside]
        if not len(next_at):
            return
        groups, previous = int(of.max()) + 1, word[next_at - k]
        leading = np.zeros(groups, previous.dtype)
        leading[group] = previous
        other = np.flatnonzero(previous != leading[group])
        if len(other):
            _, new = _numbered(group[other] * np.int64(n_words) + previous[other])
            at, new_pair = _numbered(new * np.int64(len(of)) + pair[other])
            old = pair[other[at]]
            group[other], pair[other] = groups + new, len(of) + new_pair
            of, log, q = np.append(of, groups + new[at]), np.append(log, log[old]), np.append(q, q[old])
        many = np.bincount(group, times, int(of.max()) + 1) >= limits.context
        if not many.all():
            only(many)
            if not len(next_at):
                return
        n, m = np.bincount(group, times).astype(np.int64), np.bincount(pair, times, len(of)).astype(np.int64)
        kept = np.flatnonzero((m >= limits.follow) & ~np.isnan(log))
        of_kept, m_kept = of[kept], m[kept]
        retained, backoff, opened = _decided(_sums(of_kept, m_kept, n, log[kept], q[kept]), n, limits)
        there, value, new_log, new_q = _values(of_kept, m_kept, n, log[kept], q[kept], retained, backoff)
        # Any occurrence of a group or a pair.
        one, first = np.zeros(len(n), np.int64), np.zeros(len(m), np.int64)
        one[group], first[pair] = next_at, next_at
        contexts = np.flatnonzero(retained | opened)
        yield dict(key=runs.keys(one[contexts] - k, k), n=n[contexts], value=np.where(retained, backoff, np.nan)[contexts], open=opened[contexts], length=k)
        rows = kept[there]
        yield dict(key=runs.keys(first[rows] - k, k + 1), n=m[rows], value=value[there], length=k)
        log, q = np.full(len(m), np.nan), np.full(len(m), np.nan)
        log[kept], q[kept] = new_log, new_q
        if k == length + before:
            rows = kept[opened[of_kept]]
            if len(rows):
                at = first[rows] - k
                anchor = runs.keys(_anchors(runs, at, k), min(k, ANCHOR))
                yield dict(known=True, anchor=anchor, context=runs.keys(at, k), key=runs.keys(at, k + 1), n=m[rows], log=log[rows], q=q[rows], length=k)
            return
        if not opened.all():
            only(opened)


def _growth_batch(rows: dict) -> pa.RecordBatch:
    size = len(rows["key"])
    out = []
    for name, kind in (x.split() for x in _GROWTH.split(", ")):
        if name in ("known", "open") and name not in rows:
            out.append(pa.array(np.zeros(size, bool)))
        elif name in ("known", "length"):
            out.append(pa.array(np.full(size, rows[name]), pa.bool_() if name == "known" else pa.int32()))
        elif name not in rows:
            out.append(pa.nulls(size, pa.int64() if kind == "long" else pa.float64()))
        elif kind == "double":
            out.append(pa.array(rows[name], mask=np.isnan(rows[name])))
        else:
            out.append(pa.array(rows[name].view(np.int64) if kind == "long" else rows[name]))
    return pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in _GROWTH.split(", ")])


def _grow_all(texts: DataFrame, known: DataFrame, opened: DataFrame, length: int, limits: _Limits, tree: Tree, common) -> list[DataFrame]:
    """Staged rows of all contexts longer than ``length`` words, until none is open."""
    rounds, before, some = [], BEFORE, None
    # Contexts that are not longer than an anchor are their own.
    known = known.withColumn("anchor", F.col("context"))
    places = known.agg(F.sum("n")).first()[0]
    while True:
        # By the words dealt out at most, where a text has some hundred.
        bits = _range_bits(int(places or 0) * min(length + before, 400))
        opened = _sent_along(texts, opened)
        gathered = _gathered(texts, opened, length, before, bits, common).withColumns({c: F.lit(None).cast("double" if c in ("log", "q") else "long") for c in ("key", "log", "q")})
        names = ["range", "data", "key", "log", "q"]
        of_known = known.select(F.shiftrightunsigned("anchor", 64 - bits).alias("range"), F.lit(None).cast("binary").alias("data"), "key", "log", "q")
        both = gathered.select(*names).union(of_known)

        def run(batches, length=length, before=before):
            def grown(stretches, kept):
                if not stretches or not kept:
                    return  # nothing kept, or let through by chance only
                table = pa.Table.from_batches(kept)
                key = table.column("key").to_numpy().view(np.uint64)
                order = np.argsort(key)
                own = (key[order], table.column("log").to_numpy()[order], table.column("q").to_numpy()[order])
                for group in _groups(*(np.concatenate(x) for x in zip(*stretches)), length, before):
                    batches = [_growth_batch(rows) for rows in _grow(own, *group, length, before, limits) if len(rows["key"])]
                    if batches:
                        yield from pa.Table.from_batches(batches).combine_chunks().to_batches()

            current, stretches, kept = None, [], []
            for batch in batches:
                of = batch.column(0).to_numpy()
                bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                for a, b in zip(bounds, [*bounds[1:], len(of)]):
                    if of[a] != current:
                        yield from grown(stretches, kept)
                        current, stretches, kept = of[a], [], []
                    rows = batch.slice(a, b - a)
                    stretches += [_stretches_of(x.as_buffer().to_pybytes(), common) for x in rows.column(1).drop_null()]
                    known_rows = rows.filter(rows.column(2).is_valid())
                    kept += [known_rows] if known_rows.num_rows else []
            yield from grown(stretches, kept)

        # A number of partitions that stays: how long a task takes does not show in its bytes.
        dealt = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")), "range").sortWithinPartitions("range")
        grown = stage(map_stream(dealt, run, _GROWTH), "grown")
        rounds.append(grown)
        opened.destroy()
        deepest = grown.where("value IS NOT NULL").agg(F.max("length")).first()[0]
        if deepest:
            tree.depth, tree.longest = deepest, deepest + 1
        length, before = length + before, before * FURTHER
        known = grown.where("known").select("anchor", "context", "key", "n", "log", "q")
        places, many = known.agg(F.sum("n"), F.count(F.lit(1))).first()
        over = not many
        opened = None if over else _sent_along(texts, known.select(F.col("context").alias("key")))
        if some is None and not over:
            # Near copies next to each other in a task, whose stretches then pack well; a large group takes several tasks.
            found = stage(_narrowed(texts, opened, length), "open")
            order = ["near", F.xxhash64("text")]
            texts = some = stage(found.repartitionByRange(*order).sortWithinPartitions(*order).select("text"), "near")
            unstage(found)
        elif over and some is not None:
            unstage(some)
        if over:
            return rounds


def _groups(anchor, occurrences, lengths, often, places, times, words, length, before):
    """(runs, numbers of the tokens, places, limits, occurrences) of the stretches of some whole anchors with about
    ``_GROWN`` places. Those of one anchor with more are told apart by how far they stand from it, as their contexts are."""
    _, of = np.unique(anchor, return_inverse=True)
    # What is let through by chance mostly has an anchor that occurs once.
    rows = np.flatnonzero(np.bincount(of, occurrences)[of] >= LEAST)
    if not len(rows):
        return
    order = rows[np.argsort(anchor[rows], kind="stable")]
    word_at, place_at = np.append(0, np.cumsum(lengths)), np.append(0, np.cumsum(often))
    ordered = anchor[order]
    last = np.append(np.flatnonzero(ordered[1:] != ordered[:-1]) + 1, len(order))
    total = np.cumsum(often[order])[last - 1]
    start = 0
    while start < len(order):
        so_far = total[np.searchsorted(last, start, side="right") - 1] if start else 0
        stop = int(last[min(int(np.searchsorted(total, so_far + _GROWN)), len(last) - 1)])
        rows = order[start:stop]
        token = np.concatenate([words[word_at[r] : word_at[r + 1]] for r in rows.tolist()])
        limit = np.repeat(np.append(0, np.cumsum(lengths[rows]))[:-1], often[rows])
        of_rows = np.concatenate([np.arange(place_at[r], place_at[r + 1]) for r in rows.tolist()])
        runs, (_, word) = _Runs(token), np.unique(token, return_inverse=True)
        # Equal words as far as this round looks, in stretches of other tasks too.
        reach = np.maximum(limit, limit + places[of_rows] - length - before)
        next_at, number = _alike(runs, limit + places[of_rows], reach, times[of_rows])
        limit = np.repeat(np.append(0, np.cumsum(lengths[rows]))[:-1], lengths[rows])[next_at]
        if len(next_at) <= 2 * _GROWN:
            yield runs, word, next_at, limit, number
        else:
            distance = next_at - _anchors(runs, next_at - length, length)
            by_distance = np.argsort(distance, kind="stable")
            for part in np.split(by_distance, np.flatnonzero(np.diff(distance[by_distance])) + 1):
                yield runs, word, next_at[part], limit[part], number[part]
        start = stop


def _packed(rows: DataFrame, bits: int) -> DataFrame:
    """Rows (key, n, value, open) as rows of ``Tree.runs``."""
    with _rows_of_numbers(rows.sparkSession):
        return stage(map_stream(rows, _packed_tree(bits), "range long, data binary"), "tree")


def _packed_tree(bits: int):
    """By batches of (key, n, value, open), the rows of ``Tree.runs``, by ranges of the keys."""

    def packed_rows(parts):
        key, n, value, opened = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key)
        key, n, value, opened = key[order], n[order], value[order], opened[order]
        of = (key >> np.uint64(64 - bits)).astype(np.int64)
        bounds, data = np.flatnonzero(np.append(True, of[1:] != of[:-1])), []
        for a, b in zip(bounds, [*bounds[1:], len(of)]):
            adds, is_open = a + np.flatnonzero(~np.isnan(value[a:b])), a + np.flatnonzero(opened[a:b])
            columns = packed(key[adds]) + packed(n[adds]) + packed(value[adds].view(np.uint64)) + packed(key[is_open])
            data.append(np.array([len(adds), len(is_open)], np.int64).tobytes() + columns)
        return pa.RecordBatch.from_arrays([pa.array(of[bounds]), pa.array(data, pa.binary())], names=["range", "data"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                key, n, value, opened = batch.columns
                parts.append((key.to_numpy().view(np.uint64), n.to_numpy(), value.fill_null(np.nan).to_numpy(), opened.to_numpy(zero_copy_only=False)))
                held += batch.num_rows
            if held > _HELD:
                yield packed_rows(parts)
                parts, held = [], 0
        if parts:
            yield packed_rows(parts)

    return run


def _tree_rows(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of runs that add something, how often they occur, what they add; and keys of open contexts."""
    n, m = np.frombuffer(data, np.int64, 2).tolist()
    key, at = unpacked(data, 16, n)
    often, at = unpacked(data, at, n)
    value, at = unpacked(data, at, n)
    opened, _ = unpacked(data, at, m)
    return key.astype(np.uint64), often.astype(np.int64), value.astype(np.uint64).view(np.float64), opened.astype(np.uint64)


def _tree_parts(batches):
    for batch in batches:
        for data in batch.column(0):
            yield _tree_rows(data.as_buffer().to_pybytes())


def _tree_sizes(tree: Tree) -> tuple[np.ndarray, int]:
    """How many rows add something, by the powers of two of how often they occur, and how many contexts are open."""

    def run(batches):
        total = np.zeros(65, np.int64)
        for _, n, _, opened in _tree_parts(batches):
            total[:64] += np.bincount(np.frexp(n.astype(np.float64))[1] - 1, minlength=64)
            total[64] += len(opened)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(65)), pa.array(total)], names=["size", "many"])

    total = np.zeros(65, np.int64)
    found = map_stream(tree.runs.select("data"), run, "size long, many long").toArrow()
    np.add.at(total, found.column("size").to_numpy(), found.column("many").to_numpy())
    return total[:64], int(total[64])


def _most_frequent(sizes: np.ndarray, least: float, at_most: int) -> float:
    """How often a run must occur, ``least`` times or more often, so that at most so many of them do, by powers of two."""
    behind = np.cumsum(sizes[::-1])[::-1]
    return next((max(least, float(1 << i)) for i, many in enumerate(behind) if many <= at_most and 2.0 ** (i + 1) > least), np.inf)


def score(docs: DataFrame, tree: Tree, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of every whole text.

    Tokens are the words (runs without ASCII white space, A to Z folded) and one end. ``base_score`` is the
    sum of the tokens' base log10 probabilities, ``score`` that of the tree. Empty and NULL texts are the end
    alone. One row for each row of ``docs``, repeated ids included.
    """
    sizes, many_open = _tree_sizes(tree)
    often = _most_frequent(sizes, SENT_SHARE * tree.total, SENT_RUNS)
    packed_runs = tree.runs.select("data")

    def frequent(batches):
        for key, n, value, _ in _tree_parts(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key[n >= often].view(np.int64)), pa.array(value[n >= often])], names=["key", "value"])

    runs, values = _collected(map_stream(packed_runs, frequent, "key long, value double"), "value")
    adding = Sieve(packed_runs, int(sizes.sum()), lambda batches: (key for key, *_ in _tree_parts(batches)))
    opened = Sieve(packed_runs, many_open, lambda batches: (x for *_, x in _tree_parts(batches)))
    sent = _Sent(tree.words, tree.base(tree.counts) if len(tree.words) else tree.counts, runs, values, adding, opened, tree.longest)
    shared = docs.sparkSession.sparkContext.broadcast(sent)
    bits = _range_bits(tree.total)
    schema = "id long, doc_id long, n_tokens long, n_known long, base double, score double, range long, run boolean, data binary"

    def run(batches):
        own, serial = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for chunk in chunks(batch.column(1), 1 << 20):
                token, row, first = _tokens(chunk)
                distinct, back = np.unique(token, return_inverse=True)
                number = positions(own.words, distinct)[back]
                rare = number < 0
                base = np.zeros(len(token))
                base[~rare] = own.base[number[~rare]]
                added, left = base.copy(), []
                for at, keys in _candidates(token, row, first, own):
                    may = own.adding.lets_through(keys)
                    at, keys = at[may], keys[may]
                    distinct, back = np.unique(keys, return_inverse=True)
                    place = positions(own.runs, distinct)
                    value = np.zeros(len(distinct))
                    value[place >= 0] = own.values[place[place >= 0]]
                    np.add.at(added, at, value[back])
                    still = (place < 0)[back]
                    left.append((keys[still], row[at[still]]))
                sums = [np.bincount(row, x, chunk.rows) for x in (base, added)]
                known = np.bincount(row, ~rare, chunk.rows).astype(np.int64)
                mine = batch.column(0).slice(chunk.first, chunk.rows)
                yield _batch(id=serial + np.arange(chunk.rows), doc_id=mine, n_tokens=np.diff(first), n_known=known, base=sums[0], score=sums[1])
                yield _asked(serial, False, token[rare], row[rare], bits)
                if left:
                    yield _asked(serial, True, *(np.concatenate(x) for x in zip(*left)), bits)
                serial += chunk.rows

    # Written once: the numbers given to rows must be the same for the rows and for their rare words and runs.
    parts = stage(map_stream(docs.select("doc_id", "text"), run, schema), "scored")
    shared.destroy()
    rows = parts.where("data IS NULL").select("id", "doc_id", "n_tokens", "n_known", "base", "score")
    size = max(tree.total + 0.5 * (tree.vocabulary + 1), 0.5)
    of_words = counts.select("key", F.log10((F.col("n") + 0.5) / F.lit(size)).alias("value"))
    with _rows_of_numbers(docs.sparkSession):
        of_words = stage(map_stream(of_words, _ranged_table(bits), "range long, data binary"), "table")
    none = F.lit(None).cast("long").alias("id")
    table = of_words.select("range", F.lit(False).alias("run"), none, "data").union(tree.runs.select("range", F.lit(True), none, "data"))
    asked = parts.where("data IS NOT NULL").select("range", "run", "id", "data")
    sums = []
    for part in range(SLICES):
        both = table.union(asked).where(F.col("range").bitwiseAND(SLICES - 1) == part)
        dealt = both.repartition("range").sortWithinPartitions("range", "run", F.col("id").isNotNull())
        sums.append(stage(_summed(map_stream(dealt, _looked_up(float(np.log10(0.5 / size)), often), "id long, log double, known long, more double")), "sums"))
    rare = _summed(functools.reduce(DataFrame.union, sums))
    log, known, more = F.coalesce("log", F.lit(0.0)), F.coalesce("known", F.lit(0)), F.coalesce("more", F.lit(0.0))
    return rows.join(rare, "id", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(tree.total).cast("long").alias("train_tokens"),
        (F.col("base") + log).alias("base_score"), (F.col("score") + log + more).alias("score"),
    )


def _asked(serial: int, run: bool, key: np.ndarray, row: np.ndarray, bits: int) -> pa.RecordBatch:
    """What the rows of a chunk, numbered from ``serial``, have to look up, a row for each range of the hashes."""
    order, new = _equal(key)
    at = np.append(new, len(row))
    key, row = key[order[new]], row[order]
    of = (key >> np.uint64(64 - bits)).astype(np.int64)
    bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1])[: len(of)])
    data = []
    for a, b in zip(bounds, [*bounds[1:], len(of)]):
        sizes = np.array([b - a, at[b] - at[a]], np.int64).tobytes()
        data.append(sizes + packed(key[a:b]) + packed(np.diff(at[a : b + 1])) + packed(row[at[a] : at[b]]))
    return _batch(id=np.full(len(data), serial), range=of[bounds], run=np.full(len(data), run), data=pa.array(data, pa.binary()))


def _ranged_table(bits: int):
    """By batches of (key, value), (range, data) of many rows each."""

    def packed_rows(parts):
        key, value = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key)
        key, value = key[order], value[order]
        of = (key >> np.uint64(64 - bits)).astype(np.int64)
        bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        data = [np.array([b - a], np.int64).tobytes() + packed(key[a:b]) + packed(value[a:b].view(np.uint64)) for a, b in zip(bounds, [*bounds[1:], len(of)])]
        return pa.RecordBatch.from_arrays([pa.array(of[bounds]), pa.array(data, pa.binary())], names=["range", "data"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
                held += batch.num_rows
            if held > _HELD:
                yield packed_rows(parts)
                parts, held = [], 0
        if parts:
            yield packed_rows(parts)

    return run


def _looked_up(unknown: float, often: float):
    """By batches of (range, run, id, data), a table's rows, without an id, before those that ask for them: what the rare
    words, and the runs that occur less than ``often`` times, add for each row that asks, (id, log, known, more), summed
    up within a task."""

    def answers(keys, values, run, serial, data):
        n, m = np.frombuffer(data, np.int64, 2).tolist()
        key, at = unpacked(data, 16, n)
        times, at = unpacked(data, at, n)
        row, _ = unpacked(data, at, m)
        place = positions(keys, key.astype(np.uint64))
        # A run that the sieve let through by chance is in no row of the tree.
        value = np.where(place >= 0, values[place], 0.0 if run else unknown) if len(keys) else np.full(n, 0.0 if run else unknown)
        rows, back = np.unique(row, return_inverse=True)
        total = np.bincount(back, np.repeat(value, times), len(rows))
        none = np.zeros(len(rows))
        known = none if run else np.bincount(back, np.repeat(place >= 0, times), len(rows))
        return serial + rows.astype(np.int64), none if run else total, known, total if run else none

    def summed(found):
        ids, *columns = (np.concatenate(x) for x in zip(*found))
        one, back = _numbered(ids)
        return ids[one], *(np.bincount(back, c, len(one)) for c in columns)

    def batch_of(ids, log, known, more):
        arrays = [pa.array(ids), pa.array(log), pa.array(known.astype(np.int64)), pa.array(more)]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "log", "known", "more"])

    def run(batches):
        current, parts, table, found, held = None, [], None, [], 0
        for batch in batches:
            of = batch.column(0).to_numpy() * 2 + batch.column(1).cast(pa.int64()).to_numpy()
            bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            for a, b in zip(bounds, [*bounds[1:], len(of)]):
                if of[a] != current:
                    current, parts, table = of[a], [], None
                rows = batch.slice(a, b - a)
                for serial, data in zip(rows.column(2).to_pylist(), rows.column(3)):
                    data = data.as_buffer().to_pybytes()
                    if serial is None and current & 1:
                        key, n, value, _ = _tree_rows(data)
                        parts.append((key[n < often], value[n < often]))
                        continue
                    if serial is None:
                        (n,) = np.frombuffer(data, np.int64, 1).tolist()
                        key, place = unpacked(data, 8, n)
                        parts.append((key.astype(np.uint64), unpacked(data, place, n)[0].astype(np.uint64).view(np.float64)))
                        continue
                    if table is None:
                        keys, values = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), np.zeros(0))
                        # A run may have a row as a context and one as a next word.
                        order, begin = _equal(keys)
                        table, parts = (keys[order[begin]], np.add.reduceat(values[order], begin)), []
                    found.append(answers(*table, bool(current & 1), serial, data))
                    held += len(found[-1][0])
                    if held > _HELD:
                        found = [summed(found)]
                        held = len(found[0][0])
                        if held > 3 * _HELD // 4:
                            yield batch_of(*found.pop())
                            held = 0
        if found:
            yield batch_of(*summed(found))

    return run


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("id").agg(F.sum("log").alias("log"), F.sum("known").alias("known"), F.sum("more").alias("more"))


def _candidates(token: np.ndarray, row: np.ndarray, first: np.ndarray, own: _Sent):
    """(places, keys) of the runs that may be in the tree, by their last word; those of up to ``_EACH`` words by length,
    the few longer ones together.

    A context is in it only if it is open without its first word, a run only if its context is."""
    runs = _Runs(token)
    most = np.minimum(np.arange(len(token)) - first[row] + 1, own.longest)
    # How many words the longest context has that ends at a place and is open with all that it ends in.
    opened, here, length = np.zeros(len(token), np.int64), np.arange(len(token)), 0
    while len(here):
        step = 1 if length < _EACH else max(1, min(256, (1 << 18) // len(here)))
        lengths = np.arange(length + 1, length + step + 1)
        here = here[most[here] > length]
        within = lengths <= most[here, None]
        keys = runs.keys(np.maximum(here[:, None] - lengths + 1, 0), np.minimum(lengths, here[:, None] + 1)) if length else token[here, None]
        passes = np.logical_and.accumulate(within & own.opened.lets_through(keys), axis=1).sum(axis=1)
        opened[here] += passes
        here, length = here[passes == step], length + step
    reach = opened + 1
    np.maximum(reach[1:], opened[:-1] + 2, out=reach[1:])
    reach = np.minimum(reach, most)
    here = np.arange(len(token))
    for length in range(1, _EACH + 1):
        here = here[reach[here] >= length]
        yield here, runs.keys(here - length + 1, length)
    more = reach[here] - _EACH
    here, more = here[more > 0], more[more > 0]
    for part in np.split(np.arange(len(here)), np.flatnonzero(np.diff(np.cumsum(more) >> 18)) + 1):
        at, many = np.repeat(here[part], more[part]), np.cumsum(more[part])
        lengths = _EACH + 1 + np.arange(len(at)) - np.repeat(many - more[part], more[part])
        yield at, runs.keys(at - lengths + 1, lengths)


def _batch(**columns) -> pa.RecordBatch:
    """Rows of the staged table; columns not given are NULL."""
    kinds = {k: pa.int64() for k in ("id", "doc_id", "n_tokens", "n_known")} | {"base": pa.float64(), "score": pa.float64()}
    kinds |= {"range": pa.int64(), "run": pa.bool_(), "data": pa.binary()}
    rows = len(columns["id"])
    return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in kinds.items()], names=list(kinds))

"""Phrases whose words stand together more often than chance, from weighted acyclic automata over n-grams.

An automaton reads a language and then words; the weight of the state that a path ends in is how often the
phrase occurs. Every shard of the corpus sorts its n-grams and builds an automaton by adding them in order,
where a path shares the states of its predecessor as far as both agree. Automata are cut by ranges of the
prefix (language and first two words); for every range the automata of all shards are united and their weights
summed, and phrases below the least count go. Lengths come one after the other, and only n-grams whose two parts
of one word less are frequent are counted: no other can be frequent.

The parts of a phrase are looked up by composing it with the united automata: its first words are states on its
own path, its last words are states of the automaton that reads phrases from the end.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.language_model import Sieve
from tidemill.llm.text import LOWER, Chunk, chunks, map_batches, map_stream, mix, packed, unpacked, words
from tidemill.session import stage

# What ends a piece of text, and what stands between words.
_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_SEPARATORS = _BREAKS.copy()
_SEPARATORS[[0x20, 0x09]] = True

# Language of documents that name none.
NO_LANGUAGE = "und"
# Different n-grams that a task holds, and tokens of the corpus for each range of prefixes.
_HELD = 1_000_000
_TOKENS_A_RANGE = 1 << 22
# Rows whose automaton is walked at once; phrases with the same first two words stay together.
_WALKED = 200_000
_SALTS = 64
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _next(state, label):
    """The state behind ``state`` by a word: a 64-bit hash of the whole path."""
    return mix(state * _FACTOR + label)


def _path_hash(paths: np.ndarray) -> np.ndarray:
    return functools.reduce(_next, paths[:, 1:].T, paths[:, 0])


class CountAutomaton:
    """Paths of labels with weights; states are numbered by level in the order of the sorted paths."""

    def __init__(self, depth: int):
        self.labels: list[list[np.ndarray]] = [[] for _ in range(depth)]
        self.parents: list[list[np.ndarray]] = [[] for _ in range(depth)]
        self.weights: list[list[np.ndarray]] = [[] for _ in range(depth)]
        self.sizes = [0] * depth
        self.last: np.ndarray | None = None

    def add(self, paths: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> None:
        """Append different paths in ascending order, all behind those added before; ``lengths`` tells how many
        labels of each row count, and a row sorts directly before its extensions."""
        if not len(paths):
            return
        differs = np.ones((len(paths), paths.shape[1]), bool)
        before = paths[:-1] if self.last is None else np.vstack([self.last[None], paths[:-1]])
        differs[len(paths) - len(before) :] = np.logical_or.accumulate(paths[len(paths) - len(before) :] != before, axis=1)
        above = np.zeros(len(paths), np.int64)
        for j in range(paths.shape[1]):
            reaches = lengths > j
            new = differs[:, j] & reaches
            state = self.sizes[j] - 1 + np.cumsum(new)
            at = np.flatnonzero(new)
            self.labels[j].append(paths[at, j])
            self.parents[j].append(above[at])
            weight = np.zeros(len(at), np.int64)
            ends = np.flatnonzero(lengths == j + 1)
            # A path is a new state of its last level: paths differ and come before their extensions.
            weight[np.searchsorted(at, ends)] = weights[ends]
            self.weights[j].append(weight)
            self.sizes[j] += len(at)
            above = state
        self.last = paths[-1]

    def level(self, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for parts in (self.labels, self.parents, self.weights):
            if len(parts[j]) > 1:
                parts[j] = [np.concatenate(parts[j])]
        return self.labels[j][0], self.parents[j][0], self.weights[j][0]

    def paths(self) -> tuple[np.ndarray, np.ndarray]:
        """All paths of full length with their weights, in order."""
        depth = len(self.sizes)
        label, parent, weight = self.level(depth - 1)
        out = np.empty((len(label), depth), np.uint64)
        out[:, -1] = label
        for j in range(depth - 2, -1, -1):
            label, above, _ = self.level(j)
            out[:, j] = label[parent]
            parent = above[parent]
        return out, weight

    def walk(self, paths: np.ndarray, depth: int) -> np.ndarray:
        """Weights of the states that the rows of ``paths`` pass, a column for each of ``depth`` labels; 0 where
        the automaton has no such path."""
        out = np.zeros((len(paths), depth), np.int64)
        symbols = np.unique(np.concatenate([self.level(j)[0] for j in range(depth)]))
        state = np.zeros(len(paths), np.int64)
        for j in range(depth):
            label, parent, weight = self.level(j)
            if not len(label):
                break
            arcs = parent * len(symbols) + np.searchsorted(symbols, label)
            wanted = np.minimum(np.searchsorted(symbols, paths[:, j]), len(symbols) - 1)
            wanted = np.where((symbols[wanted] == paths[:, j]) & (state >= 0), state * len(symbols) + wanted, -1)
            at = np.minimum(np.searchsorted(arcs, wanted), len(arcs) - 1)
            state = np.where(arcs[at] == wanted, at, -1)
            out[:, j] = np.where(state >= 0, weight[state], 0)
        return out

    def to_bytes(self) -> bytes:
        """Sizes, symbols, and for every level the number of arcs behind each state and the labels, as steps from one
        arc of a state to the next; then the weights of the last level."""
        levels = [self.level(j) for j in range(len(self.sizes))]
        symbols = np.unique(np.concatenate([x[0] for x in levels]))
        out = [np.array([len(symbols), len(levels), *self.sizes], np.int64).tobytes(), packed(symbols)]
        states = 1
        for label, parent, _ in levels:
            step = np.searchsorted(symbols, label)
            step[1:] -= np.where(parent[1:] == parent[:-1], step[:-1], 0)
            out += [packed(np.bincount(parent, minlength=states)), packed(step)]
            states = len(label)
        return b"".join([*out, packed(levels[-1][2])])

    @staticmethod
    def from_bytes(data: bytes) -> CountAutomaton:
        """What ``to_bytes`` wrote; weights are those of full paths."""
        n, depth = np.frombuffer(data, np.int64, 2).tolist()
        sizes = np.frombuffer(data, np.int64, depth, 16).tolist()
        symbols, at = unpacked(data, 16 + 8 * depth, n)
        symbols = symbols.astype(np.uint64)
        out = CountAutomaton(depth)
        out.sizes = sizes
        states = 1
        for j, size in enumerate(sizes):
            arcs, at = unpacked(data, at, states)
            step, at = unpacked(data, at, size)
            label = np.cumsum(step.astype(np.int64))
            first = (np.cumsum(arcs) - arcs)[arcs > 0].astype(np.int64)
            # Sums begin anew with every state.
            before = label[first] - step[first].astype(np.int64)
            label -= np.repeat(before, arcs[arcs > 0].astype(np.int64))
            out.parents[j], out.labels[j] = [np.repeat(np.arange(states), arcs.astype(np.int64))], [symbols[label]]
            out.weights[j] = [np.zeros(size, np.int64)]
            states = size
        weights, _ = unpacked(data, at, sizes[-1])
        out.weights[-1] = [weights.astype(np.int64)]
        return out


@dataclass
class _Tokens:
    """Words of a chunk, their language, and which of them go on with the piece of the word before."""

    word: np.ndarray
    language: np.ndarray
    joined: np.ndarray


def _tokens(chunk: Chunk, languages: np.ndarray) -> _Tokens:
    found = words(chunk, separators=_SEPARATORS)
    joined = np.zeros(len(found.hash), bool)
    if len(joined):
        breaks = np.cumsum(_BREAKS[chunk.bytes])
        joined[1:] = (breaks[found.start[1:]] == breaks[found.start[:-1]]) & (found.row[1:] == found.row[:-1])
    return _Tokens(found.hash, languages[chunk.first + found.row], joined)


def _ends(tokens: _Tokens, length: int) -> np.ndarray:
    """Where runs of ``length`` words of one piece end."""
    whole = np.ones(len(tokens.word), bool)
    for j in range(length - 1):
        whole[j:] &= tokens.joined[: max(len(whole) - j, 0)]
    if length > 1:
        whole[: length - 1] = False
    return whole


def _grams(tokens: _Tokens, length: int) -> np.ndarray:
    """The path hash of the language and ``length`` words that end at each token; of use where ``_ends`` is."""
    state = tokens.language.copy()
    n = len(state)
    for j in range(length):
        # The word ``length - 1 - j`` places before the last.
        back = length - 1 - j
        label = np.zeros(n, np.uint64)
        label[back:] = tokens.word[: max(n - back, 0)]
        state = _next(state, label)
    return state


def _word_counts(texts: DataFrame) -> DataFrame:
    """(language, word, n) of all words, summed up within a task first."""

    def merged(parts):
        language, word, n = (np.concatenate(x) for x in zip(*parts))
        key, at, back = np.unique(_next(language, word), return_index=True, return_inverse=True)
        return language[at], word[at], np.bincount(back, n, len(at)).astype(np.int64)

    def rows(parts) -> pa.RecordBatch:
        language, word, n = merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (language, word, n)], names=["language", "word", "n"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            languages = batch.column(1).to_numpy().view(np.uint64)
            for chunk in chunks(batch.column(0)):
                tokens = _tokens(chunk, languages)
                parts.append(merged([(tokens.language, tokens.word, np.ones(len(tokens.word)))]))
                held += len(parts[-1][0])
                if held > _HELD:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if 2 * held > _HELD:
                        yield rows(parts)
                        parts, held = [], 0
        if parts:
            yield rows(parts)

    counted = map_stream(texts, run, "language long, word long, n long")
    return counted.groupBy("language", "word").agg(F.sum("n").alias("n"))


def _with_keys(counted: DataFrame) -> DataFrame:
    """(key, language, word, n): with the path hash of a language and one word."""

    def run(batch: pa.RecordBatch):
        key = _next(*(batch.column(i).to_numpy().view(np.uint64) for i in range(2)))
        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *batch.columns], names=["key", "language", "word", "n"])

    return map_batches(counted.select("language", "word", "n"), run, "key long, language long, word long, n long")


def _range_of(paths: np.ndarray, ranges: int) -> np.ndarray:
    """The range of the prefix of language and two words."""
    return (_path_hash(paths[:, :3]) >> np.uint64(64 - (ranges.bit_length() - 1))).astype(np.int64)


def _shard_automata(texts: DataFrame, length: int, frequent, ranges: int) -> DataFrame:
    """(range, automaton) of the n-grams of ``length`` words in each task's share of the texts."""

    def merged(parts):
        key, paths, n = (np.concatenate(x) for x in zip(*parts))
        key, at, back = np.unique(key, return_index=True, return_inverse=True)
        return key, paths[at], np.bincount(back, n, len(at)).astype(np.int64)

    def automata(key, paths, n) -> Iterator[pa.RecordBatch]:
        of = _range_of(paths, ranges)
        order = np.lexsort((*paths.T[::-1], of))
        of, paths, n = of[order], paths[order], n[order]
        bounds = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        built = []
        for start, stop in zip(bounds, [*bounds[1:], len(of)]):
            automaton = CountAutomaton(length + 1)
            automaton.add(paths[start:stop], np.full(stop - start, length + 1), n[start:stop])
            built.append(automaton.to_bytes())
        yield pa.RecordBatch.from_arrays([pa.array(of[bounds]), pa.array(built, pa.binary())], names=["range", "automaton"])

    def run(batches):
        sieve, parts, held = frequent.value, [], 0
        for batch in batches:
            languages = batch.column(1).to_numpy().view(np.uint64)
            for chunk in chunks(batch.column(0)):
                tokens = _tokens(chunk, languages)
                shorter = _grams(tokens, length - 1)
                passes = np.zeros(len(shorter), bool)
                inside = np.flatnonzero(_ends(tokens, length - 1))
                passes[inside] = sieve.lets_through(shorter[inside])
                end = np.flatnonzero(_ends(tokens, length))
                # Both parts that are one word shorter have to be frequent.
                end = end[passes[end] & passes[end - 1]]
                if not len(end):
                    continue
                key, at, n = np.unique(_next(shorter[end - 1], tokens.word[end]), return_index=True, return_counts=True)
                last = end[at]
                paths = np.stack([tokens.language[last], *(tokens.word[last - back] for back in range(length - 1, -1, -1))], axis=1)
                parts.append((key, paths, n))
                held += len(key)
                if held > _HELD:
                    parts = [merged(parts)]
                    held = len(parts[0][0])
                    if 2 * held > _HELD:
                        yield from automata(*parts[0])
                        parts, held = [], 0
        if parts:
            yield from automata(*merged(parts))

    return map_stream(texts, run, "range long, automaton binary")


_PHRASES = "key long, prefix long, suffix long, path array<long>, n long"


def _longs(paths: np.ndarray) -> pa.Array:
    flat = pa.array(np.ascontiguousarray(paths).view(np.int64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.arange(len(paths) + 1, dtype=np.int32) * paths.shape[1]), flat)


def _united(automata: DataFrame, least: int) -> DataFrame:
    """Phrases that occur ``least`` times over all shards: the united automaton of every range, its weights summed.

    ``prefix`` and ``suffix`` are the keys of the phrase without its last and without its first word."""

    def merged(parts):
        paths, n = (np.concatenate(x) for x in zip(*parts))
        key, at, back = np.unique(_path_hash(paths), return_index=True, return_inverse=True)
        return paths[at], np.bincount(back, n, len(at)).astype(np.int64)

    def phrases(parts) -> pa.RecordBatch:
        paths, n = merged(parts)
        paths, n = paths[n >= least], n[n >= least]
        suffix = np.delete(paths, 1, axis=1)
        keys = [_path_hash(paths), _path_hash(paths[:, :-1]), _path_hash(suffix)]
        return pa.RecordBatch.from_arrays([*(pa.array(k.view(np.int64)) for k in keys), _longs(paths), pa.array(n)], names=["key", "prefix", "suffix", "path", "n"])

    def run(batches):
        current, parts, held = None, [], 0
        for batch in batches:
            for at, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at != current and parts:
                    yield phrases(parts)
                    parts, held = [], 0
                current = at
                parts.append(CountAutomaton.from_bytes(data.as_buffer().to_pybytes()).paths())
                held += len(parts[-1][0])
                if held > 2 * _HELD:
                    parts = [merged(parts)]
                    held = len(parts[0][0]) // 2
        if parts:
            yield phrases(parts)

    return map_stream(automata.repartition("range").sortWithinPartitions("range"), run, _PHRASES)


def _composed(phrases: DataFrame, output: str, from_end: bool) -> DataFrame:
    """Add, for every phrase, how often its first 2, 3, ... words occur (its last, if ``from_end``), without the
    whole phrase: the weights that its path passes in the automaton of all phrases of its range."""
    order = "concat(slice(path, 1, 1), reverse(slice(path, 2, 5)))" if from_end else "path"
    # Language and two words: what the automata are cut by.
    ranged = phrases.withColumn("_read", F.expr(order)).withColumn("_range", F.xxhash64(F.slice("_read", 1, 3)))
    schema = f"{_PHRASES}, {output} array<long>"
    kept = [c for c in phrases.columns if c not in ("key", "prefix", "suffix", "path", "n")]
    for c in kept:
        schema = schema.replace(f", {output} ", f", {c} {dict(phrases.dtypes)[c]}, {output} ")

    def walked(batch: pa.RecordBatch) -> pa.RecordBatch:
        read = batch.column(batch.schema.get_field_index("_read"))
        lengths = np.diff(read.offsets.to_numpy())
        flat = read.values.to_numpy().view(np.uint64)[read.offsets[0].as_py() :]
        starts = np.append(0, np.cumsum(lengths))[:-1]
        paths = np.zeros((len(lengths), int(lengths.max())), np.uint64)
        for j in range(paths.shape[1]):
            has = lengths > j
            paths[has, j] = flat[starts[has] + j]
        # Shorter paths first, as their padding is the least label; ties by length keep them apart from label 0.
        order = np.lexsort((lengths, *paths.T[::-1]))
        automaton = CountAutomaton(paths.shape[1])
        automaton.add(paths[order], lengths[order], batch.column(batch.schema.get_field_index("n")).to_numpy()[order])
        passed = automaton.walk(paths, paths.shape[1])
        # Weights of 2, 3, ... words; the last label is the phrase itself.
        parts = [row[2 : k - 1].tolist() for row, k in zip(passed, lengths)]
        names = [*("key", "prefix", "suffix", "path", "n"), *kept]
        columns = [batch.column(batch.schema.get_field_index(c)) for c in names]
        return pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.list_(pa.int64()))], names=[*names, output])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < _WALKED:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            of = whole.column("_range").to_numpy()
            # The last prefix may go on in the next batch.
            stop = int(np.searchsorted(of, of[-1]))
            if stop:
                yield walked(whole.slice(0, stop).combine_chunks().to_batches()[0])
            held = whole.slice(stop).combine_chunks().to_batches()
            n = len(whole) - stop
        if n:
            yield walked(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return map_stream(ranged.repartition("_range").sortWithinPartitions("_range"), run, schema)


def _names(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(word, name): the words whose hashes are the keys of ``wanted``, spelt out."""
    shared = texts.sparkSession.sparkContext.broadcast(Sieve(wanted))

    def run(batches):
        sieve, seen = shared.value, set()
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                found = words(chunk, separators=_SEPARATORS)
                distinct, first = np.unique(found.hash, return_index=True)
                passes = np.flatnonzero(sieve.lets_through(distinct))
                new = [(h, first[i]) for i, h in zip(passes.tolist(), distinct[passes].tolist()) if h not in seen]
                if len(seen) > _HELD:
                    seen.clear()
                seen.update(h for h, _ in new)
                name = [LOWER[chunk.bytes[found.start[i] : found.end[i]]].tobytes().decode(errors="replace") for _, i in new]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([h for h, _ in new], np.uint64).view(np.int64)), pa.array(name, pa.string())], names=["word", "name"])

    found = map_stream(texts, run, "word long, name string")
    return found.join(wanted.select(F.col("key").alias("word")), "word", "left_semi").groupBy("word").agg(F.min(F.struct("name")).alias("_name")).select("word", "_name.name")


def frequent_phrases(texts: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Over (text, language) rows: frequent words (key, language, word, n), the number of words of every language,
    and the phrases of 2 to ``longest`` words that occur ``least`` times (key, prefix, suffix, path, n)."""
    spark = texts.sparkSession
    all_words = stage(_word_counts(texts), "words")
    totals = stage(all_words.groupBy("language").agg(F.sum("n").alias("total")), "totals")
    tokens = totals.agg(F.coalesce(F.sum("total"), F.lit(0))).first()[0]
    ranges = 1 << max(6, min(20, int(tokens // _TOKENS_A_RANGE).bit_length()))
    frequent = stage(_with_keys(all_words.where(F.col("n") >= least)), "frequent")
    shorter, parts = frequent, []
    for length in range(2, longest + 1):
        shared = spark.sparkContext.broadcast(Sieve(shorter.select("key")))
        shorter = stage(_united(_shard_automata(texts, length, shared, ranges), least), "phrases")
        shared.unpersist()
        parts.append(shorter)
        if shorter.isEmpty():
            break
    return frequent, totals, functools.reduce(DataFrame.union, parts)


def _lowest_cut(n_words: Column) -> Column:
    """The cut of least score (score, cut, l, r) of phrases with ``a``, ``total`` and the counts of their parts."""

    def score(cut: Column) -> Column:
        left, right = F.element_at("left", cut), F.element_at("right", cut)
        # Decimals of 38 digits: 1000 * a * n has at most 3 + 19 + 19, which real counts do not reach.
        wide = lambda c: c.cast("decimal(19,0)")
        over, under = (wide(F.col("n")) * wide(F.col("total")) * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)")
        return F.struct(F.call_function("div", over, under).alias("score"), cut.alias("cut"), left.alias("l"), right.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), n_words - 1), score))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = 5, least: int = 100, first: int = 2000) -> DataFrame:
    """The ``first`` phrases of every language (lang, rank, phrase, a, l, r, n, score).

    Texts have A to Z folded and are cut into pieces at ``. , ; : ! ?`` and line ends, pieces into words at spaces
    and tabs; NULL texts are empty, a NULL language is ``NO_LANGUAGE``. ``a`` is how often a phrase of 2 to
    ``longest`` words occurs in pieces, overlaps included, at least ``least``; ``n`` the words of its language; ``l``
    and ``r`` the counts of its two parts at the cut with the least score, floor(1000 a n / (l r)), the earliest of
    equal ones. Phrases that lie in a longer one that occurs as often are left out. Order: score and ``a`` from the
    highest, then the phrase's bytes. Repeated rows count as often as they stand; no rows, or none frequent enough,
    give none. Words and paths are told apart by 64-bit hashes.
    """
    language = F.coalesce(F.col(lang), F.lit(NO_LANGUAGE))
    texts = docs.select(F.col(text).alias("text"), F.xxhash64(language).alias("language"))
    frequent, totals, phrases = frequent_phrases(texts, longest, least)
    # A longer phrase that occurs as often has an extension by one word in between that does too.
    longer = phrases.select(F.col("prefix").alias("key"), "n").union(phrases.select(F.col("suffix").alias("key"), "n"))
    longer = longer.groupBy("key").agg(F.max("n").alias("_longer"))
    parts = _composed(_composed(phrases, "firsts", False), "lasts", True)
    parts = parts.join(longer, "key", "left").where(F.col("_longer").isNull() | (F.col("_longer") < F.col("n")))
    parts = parts.withColumns({"language": F.get("path", F.lit(0)), "_one": F.get("path", F.lit(1)), "_end": F.element_at("path", -1)})
    one = frequent.select("language", F.col("word").alias("_one"), F.col("n").alias("_n_one"))
    end = frequent.select("language", F.col("word").alias("_end"), F.col("n").alias("_n_end"))
    parts = parts.join(one, ["language", "_one"]).join(end, ["language", "_end"]).join(totals, "language")
    # Counts of the first 1, 2, ... words, and of what is left behind them.
    parts = parts.withColumns({"left": F.concat(F.array("_n_one"), "firsts"), "right": F.concat(F.reverse("lasts"), F.array("_n_end"))})
    scored = parts.withColumn("_cut", _lowest_cut(F.size("path") - 1))
    scored = scored.select("key", "language", "path", F.col("n").alias("a"), F.col("total").alias("n"), "_cut.score", "_cut.l", "_cut.r")
    # The ranks are narrowed in two steps, so that no task gets a whole language; equal ranks stay for the spelling.
    best = [F.desc("score"), F.desc("a")]
    salted = scored.withColumn("_salt", F.pmod("key", F.lit(_SALTS))).withColumn("_rank", F.rank().over(Window.partitionBy("language", "_salt").orderBy(*best)))
    few = salted.where(F.col("_rank") <= first).withColumn("_rank", F.rank().over(Window.partitionBy("language").orderBy(*best))).where(F.col("_rank") <= first)
    few = stage(few.drop("_salt", "_rank"), "best")
    spelt = few.select("key", F.posexplode(F.slice("path", 2, longest)).alias("at", "word"))
    names = _names(texts.select("text"), stage(spelt.select(F.col("word").alias("key")).distinct(), "wanted"))
    phrase = spelt.join(names, "word").groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]), " ").alias("phrase"))
    languages = docs.groupBy(F.xxhash64(language).alias("language")).agg(F.min(F.struct(language.alias("lang"))).alias("_lang")).select("language", "_lang.lang")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase")).cast("long")
    ranked = few.join(phrase, "key").join(languages, "language").withColumn("rank", rank).where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

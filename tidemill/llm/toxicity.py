"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

Terms are words and word beginnings, and their repetitions. Those that go with the label are chosen by a
chi-squared test on the examples; how rare each is, is counted over all documents. Examples stand in an inverted index whose posting lists are cut into blocks of
neighbouring examples, each with the highest weight in it. A search takes the blocks in the order of the
best similarity they could hold and stops when no block left can enter the nearest ones, so it is exact.
Similar neighbours vote with their similarity; the votes are calibrated on the examples themselves, each
scored by the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.text import LOWER, NOT_ALPHANUMERIC, Chunk, chunks, counts_by_row, map_batches, mix, positions, prefix_hashes, stretch_hash, words

# The most labelled documents that serve as examples, and the most terms that are chosen.
SAMPLE_DOCUMENTS = 8_000
MOST_TERMS = 4_096
NEIGHBOURS = 15
# Chi-squared with one degree of freedom for about one in 10 million.
LEAST_CHI2 = 28.0
BLOCK = 32


# Byte lengths of the word beginnings that are terms beside the whole word, and the counts from which a term
# that a text repeats is a further term.
PREFIXES = (4, 5, 6, 7, 8)
LEVELS = (1, 2, 4)
_KNOWN_BITS = 20


class Vocabulary:
    """Chosen terms, sorted, with a bitmap that lets through few others before they are looked up."""

    def __init__(self, terms: np.ndarray, bases: np.ndarray):
        self.terms, self.bases = terms, np.unique(bases)
        self.maybe = np.zeros(1 << _KNOWN_BITS, bool)
        self.maybe[self.bases & np.uint64((1 << _KNOWN_BITS) - 1)] = True

    def __len__(self) -> int:
        return len(self.terms)

    def among(self, bases: np.ndarray) -> np.ndarray:
        hit = np.flatnonzero(self.maybe[bases & np.uint64((1 << _KNOWN_BITS) - 1)])
        return hit[positions(self.bases, bases[hit]) >= 0]


def _terms(chunk: Chunk, vocabulary: Vocabulary | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of every row as (term, base, row, count): words and word beginnings, and again at each level of
    repetition. With a vocabulary, only terms whose base is in it."""
    found = words(chunk, separators=NOT_ALPHANUMERIC)
    size = found.end - found.start
    prefixes = prefix_hashes(LOWER[chunk.bytes])
    bases, rows = [], []
    for length in (0, *PREFIXES):
        at = np.flatnonzero(size > length)
        if length:
            base = mix(stretch_hash(prefixes, found.start[at], found.start[at] + length) + np.uint64(length << 32))
        else:
            base = found.hash
        row = found.row[at]
        if vocabulary is not None:
            keep = vocabulary.among(base)
            base, row = base[keep], row[keep]
        bases.append(base)
        rows.append(row)
    base, row, n = counts_by_row(np.concatenate(bases), np.concatenate(rows))
    parts = [(mix(base[n >= least] + np.uint64(least)), base[n >= least], row[n >= least], n[n >= least]) for least in LEVELS]
    term, base, row, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(row, kind="stable")
    return term[order], base[order], row[order], n[order]


def _in_texts(texts: DataFrame, vocabulary: Vocabulary | None = None) -> DataFrame:
    """(term, base, n): in how many texts each term stands."""

    def count(batch: pa.RecordBatch):
        for chunk in chunks(batch.column(0)):
            term, base, _, _ = _terms(chunk, vocabulary)
            distinct, at, n = np.unique(term, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(distinct.view(np.int64)), pa.array(base[at].view(np.int64)), pa.array(n)], names=["term", "base", "n"]
            )

    counted = map_batches(texts.select("text"), count, "term long, base long, n long")
    return counted.groupBy("term", "base").agg(F.sum("n").alias("n"))


def choose_terms(examples: DataFrame, least_chi2: float = LEAST_CHI2, at_most: int = MOST_TERMS) -> Vocabulary:
    """The terms whose presence goes with label 1; none if a label is missing.

    Only terms of at least three examples with label 1 can pass the test, so these are counted first.
    """
    sizes = examples.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("n1")).first()
    n, n1 = float(sizes["n"]), float(sizes["n1"])
    none = np.zeros(0, np.uint64)
    if not 0 < n1 < n:
        return Vocabulary(none, none)
    # Bounded by the examples, not by the corpus.
    ones = _in_texts(examples.where("label = 1")).where("n >= 3").toPandas().sort_values("term")
    if not len(ones):
        return Vocabulary(none, none)
    term = ones["term"].to_numpy(np.int64)
    candidates = Vocabulary(term.view(np.uint64), ones["base"].to_numpy(np.int64).view(np.uint64))
    zeros = _in_texts(examples.where("label = 0"), candidates).toPandas()
    n0_of = dict(zip(zeros["term"], zeros["n"]))
    a1 = ones["n"].to_numpy(np.float64)
    a = a1 + np.array([n0_of.get(t, 0) for t in term], np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = np.where((a1 * n > a * n1) & (a < n), n * (a1 * (n - n1) - (a - a1) * n1) ** 2 / (n1 * (n - n1) * a * (n - a)), 0)
    best = np.lexsort((term, -chi2))[:at_most]
    best = best[chi2[best] >= least_chi2]
    chosen = np.sort(term[best].view(np.uint64))
    return Vocabulary(chosen, ones["base"].to_numpy(np.int64).view(np.uint64)[best])


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """How many texts there are, and in how many of them each term stands, over all documents."""

    def count(batch: pa.RecordBatch):
        total = np.zeros(len(vocabulary) + 1, np.int64)
        total[-1] = batch.num_rows
        for chunk in chunks(batch.column(0)):
            at = positions(vocabulary.terms, _terms(chunk, vocabulary)[0])
            total[:-1] += np.bincount(at[at >= 0], minlength=len(vocabulary))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["at", "n"])

    out = np.zeros(len(vocabulary) + 1, np.int64)
    # At most one row for each chosen term.
    for r in map_batches(docs.select("text"), count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return int(out[-1]), out[:-1]


class Index:
    """Terms, their weights, and the examples' postings in blocks. Read-only once built; its size is bounded
    by the number of examples and terms."""

    def __init__(self, terms: Vocabulary, idf: np.ndarray, block: int = BLOCK):
        self.terms, self.idf, self.block = terms, idf, block
        self.ids, self.labels = np.zeros(0, np.int64), np.zeros(0)
        self.curve = (1.0, 0.0)
        self.apart = 0.0

    def vector(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Unit TF-IDF weights of a text's chosen terms, with logarithmic term counts."""
        w = (1 + np.log(counts)) * self.idf[at]
        return w / np.sqrt((w * w).sum())

    def fill(self, ids: list, labels: list, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS):
        """Post the examples that have a chosen term; the others tell how a text without any is scored."""
        with_terms = [i for i, (at, _) in enumerate(vectors) if len(at)]
        without = [labels[i] for i, (at, _) in enumerate(vectors) if not len(at)]
        self.apart = (sum(without) + 0.5) / (len(without) + 1.0) if len(without) else 0.5
        # Neighbouring examples share their heaviest term, which keeps the blocks' bounds low.
        with_terms.sort(key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), -float(vectors[i][1].max()), ids[i]))
        self.ids = np.array([ids[i] for i in with_terms], np.int64)
        self.labels = np.array([labels[i] for i in with_terms], np.float64)
        n = len(with_terms)
        self.n_blocks = -(-n // self.block)
        term = np.concatenate([vectors[i][0] for i in with_terms]) if n else np.zeros(0, np.int64)
        example = np.repeat(np.arange(n), [len(vectors[i][0]) for i in with_terms]) if n else np.zeros(0, np.int64)
        weight = np.concatenate([vectors[i][1] for i in with_terms]) if n else np.zeros(0)
        order = np.lexsort((example, term))
        self.post_example, self.post_weight = example[order], weight[order]
        key = term[order] * max(1, self.n_blocks) + self.post_example // self.block
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        self.block_key, self.block_start = key[starts], np.append(starts, len(key))
        self.block_max = np.maximum.reduceat(self.post_weight, starts) if len(starts) else np.zeros(0)
        self.term_start = np.searchsorted(self.block_key, np.arange(len(self.terms) + 1) * max(1, self.n_blocks))
        self._calibrate([vectors[i] for i in with_terms], k)
        return self

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples with the highest cosine above 0, best first (of equals, the earlier posted)."""
        lists = [np.arange(self.term_start[t], self.term_start[t + 1]) for t in at]
        at_block = np.concatenate(lists) if lists else np.zeros(0, np.int64)
        if not len(at_block):
            return np.zeros(0, np.int64), np.zeros(0)
        query = np.repeat(weights, [len(x) for x in lists])
        block = self.block_key[at_block] % self.n_blocks
        bound = np.bincount(block, query * self.block_max[at_block], self.n_blocks)
        by_block = np.argsort(block, kind="stable")
        first = np.searchsorted(block[by_block], np.arange(self.n_blocks + 1))
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        order = np.argsort(-bound, kind="stable")
        step = 8
        for lo in range(0, len(order), step):
            some = order[lo : lo + step]
            # The small margin covers rounding in the sums, so nothing is passed over.
            if bound[some[0]] <= 0 or len(best) == k and bound[some[0]] < best[-1] - 1e-9:
                break
            similar = np.zeros(step * self.block)
            slot = {int(b): j for j, b in enumerate(some)}
            for b in some:
                for i in by_block[first[b] : first[b + 1]]:
                    s, e = self.block_start[at_block[i]], self.block_start[at_block[i] + 1]
                    similar[self.post_example[s:e] - b * self.block + slot[int(b)] * self.block] += query[i] * self.post_weight[s:e]
            hit = np.flatnonzero(similar)
            example = some[hit // self.block] * self.block + hit % self.block
            keep = example != but
            best_at = np.concatenate([best_at, example[keep]])
            best = np.concatenate([best, similar[hit[keep]]])
            top = np.lexsort((best_at, -best))[:k]
            best_at, best = best_at[top], best[top]
        return best_at, best

    def vote(self, near: np.ndarray, similar: np.ndarray) -> float:
        """Share of label 1 among the neighbours, each with its squared similarity."""
        w = similar**2
        return float((w * self.labels[near]).sum() / w.sum())

    def _calibrate(self, vectors: list, k: int):
        """A logistic curve from votes to labels, fitted on each example's votes by the others."""
        votes, y = [], []
        for i, (at, w) in enumerate(vectors):
            near, similar = self.nearest(at, w, k, but=i)
            if len(near):
                votes.append(self.vote(near, similar))
                y.append(self.labels[i])
        if not 0 < sum(y) < len(y):
            # One class only: the votes are as they should be.
            self.curve = None
            return
        x, y = np.array(votes) - 0.5, np.array(y)
        # Targets drawn in a little, so that perfect votes do not send the curve to infinity.
        n1, n0 = y.sum(), len(y) - y.sum()
        t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        a, b = 4.0, 0.0
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g, h = t - p, p * (1 - p) + 1e-9
            hess = np.array([[(h * x * x).sum() + 1e-3, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-3]])
            step = np.linalg.solve(hess, [(g * x).sum(), g.sum()])
            a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -2, 2))
        self.curve = (a, b)

    def score(self, at: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Score, ids of the nearest examples and their similarities."""
        if len(at):
            near, similar = self.nearest(at, self.vector(at, counts))
            if len(near):
                vote = self.vote(near, similar)
                if self.curve is not None:
                    vote = float(1 / (1 + np.exp(-np.clip(self.curve[0] * (vote - 0.5) + self.curve[1], -30, 30))))
                return vote, self.ids[near], similar
        return self.apart, self.ids[:0], np.zeros(0)


def _split(column: pa.Array, vocabulary: Vocabulary):
    """For every row: positions of its chosen terms and their counts."""
    for chunk in chunks(column):
        term, _, row, n = _terms(chunk, vocabulary)
        at = positions(vocabulary.terms, term)
        at, row, n = at[at >= 0], row[at >= 0], n[at >= 0]
        first = np.searchsorted(row, np.arange(chunk.rows + 1))
        for r in range(chunk.rows):
            yield at[first[r] : first[r + 1]], n[first[r] : first[r + 1]]


def build(docs: DataFrame, examples: DataFrame) -> Index:
    """The index of bounded labelled ``examples`` (doc_id, text, label), with term rarity from all ``docs``.

    Examples of one label, or none, give an index without terms: every text then gets the examples' rate
    of label 1 (0.5 without examples).
    """
    terms = choose_terms(examples)
    n, df = document_frequencies(docs, terms) if len(terms) else (0, np.zeros(0))
    index = Index(terms, np.log((n + 1) / (df + 0.5)))

    def vectors(batch: pa.RecordBatch):
        found = list(_split(batch.column(2), terms))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array([a for a, _ in found], pa.list_(pa.int64())), pa.array([c for _, c in found], pa.list_(pa.int64()))],
            names=["doc_id", "label", "at", "n"],
        )

    rows = map_batches(examples.select("doc_id", "label", "text"), vectors, "doc_id long, label int, at array<long>, n array<long>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["at"], r["n"]))
    made = [(np.array(r["at"], np.int64), np.array(r["n"], np.float64)) for r in rows]
    made = [(at, index.vector(at, c) if len(at) else c) for at, c in made]
    return index.fill([r["doc_id"] for r in rows], [r["label"] for r in rows], made)


def score(docs: DataFrame, index: Index) -> DataFrame:
    """``docs`` with ``score``, ``neighbours`` and ``similarities``: every whole text's score and the examples it rests on.

    Texts without a chosen term, empty and NULL ones too, share the smoothed rate of label 1 among the
    examples without any, and have no neighbours. Rows stay as they are; columns with the outputs' names are
    replaced.
    """
    docs = docs.drop("score", "neighbours", "similarities")
    shared, at_text = docs.sparkSession.sparkContext.broadcast(index), docs.columns.index("text")
    added = T.StructType.fromDDL("score double, neighbours array<long>, similarities array<double>")
    schema = T.StructType([*docs.schema.fields, *added.fields])

    def run(batch: pa.RecordBatch):
        own = shared.value
        found = [own.score(at, n.astype(np.float64)) for at, n in _split(batch.column(at_text), own.terms)]
        outputs = [pa.array([s for s, _, _ in found], pa.float64())]
        outputs += [pa.array([x[i] for x in found], pa.list_(k)) for i, k in ((1, pa.int64()), (2, pa.float64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *outputs], names=schema.names)

    return map_batches(docs, run, schema)

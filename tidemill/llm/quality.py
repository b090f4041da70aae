"""Document quality by attention over passages.

A document is a bag of passages of 50 words. Each passage is described by its characters and words and
encoded by one learned layer; gated attention weighs the passages, and the weighted sum of their encodings
gives the score. Only documents carry labels; encoder, attention and score are learned from them together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemill.llm.text import Chunk, chunks, map_batches, words

PASSAGE_WORDS = 50
# The most labelled documents, and the most of their passages, that the model is fitted on.
SAMPLE_DOCUMENTS = 6_000
SAMPLE_PASSAGES = 150_000

_BUCKETS = 24
_HIDDEN = 24
_GATE = 16


def _byte_class(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in characters]] = True
    return table


_CLASSES = [
    _byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _byte_class("abcdefghijklmnopqrstuvwxyz"),
    _byte_class("0123456789"),
    _byte_class(".,;:'\"()-"),
    _byte_class("!?"),
    _byte_class("#$%&*@^~<>=+\\/[]{}_`"),
    _byte_class("|"),
    _byte_class("\n"),
    np.arange(256) >= 128,
]
N_FEATURES = len(_CLASSES) + 8 + _BUCKETS


def passages(chunk: Chunk, length: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage, and the first passage of each row (one more entry at the end).

    A text without words has one passage of zeros.
    """
    found = words(chunk, lower=False)
    counts = np.diff(found.first)
    per_row = np.maximum(1, -(-counts // length))
    first = np.concatenate(([0], np.cumsum(per_row)))
    n = int(first[-1])
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(found.hash):
        return out, first
    within = np.arange(len(found.hash)) - found.first[found.row]
    passage = first[found.row] + within // length
    at = np.flatnonzero(np.diff(passage, prepend=-1))
    own = passage[at]
    start, end = found.start[at], found.end[np.append(at[1:], len(passage)) - 1]
    size = (end - start).astype(np.float64)
    for k, table in enumerate(_CLASSES):
        total = np.concatenate(([0], np.cumsum(table[chunk.bytes])))
        out[own, k] = (total[end] - total[start]) / size
    sums = lambda values: np.bincount(passage, values, n)[own]
    n_words = sums(None)
    long = (found.end - found.start).astype(np.float64)
    repeats = np.zeros(len(long))
    repeats[1:] = (found.hash[1:] == found.hash[:-1]) & (found.row[1:] == found.row[:-1])
    first_byte, last_byte = chunk.bytes[found.start], chunk.bytes[found.end - 1]
    order = np.lexsort((found.hash, passage))
    new = np.ones(len(order), bool)
    new[1:] = (found.hash[order][1:] != found.hash[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    distinct = np.bincount(passage[order], new, n)[own]
    k = len(_CLASSES)
    mean = sums(long) / n_words
    out[own, k] = sums(repeats) / n_words
    out[own, k + 1] = distinct / n_words
    out[own, k + 2] = mean / 10
    out[own, k + 3] = np.sqrt(np.maximum(0, sums(long**2) / n_words - mean**2)) / 10
    out[own, k + 4] = sums(_CLASSES[0][first_byte]) / n_words
    out[own, k + 5] = sums(_CLASSES[3][last_byte]) / n_words
    out[own, k + 6] = sums(long == 1) / n_words
    out[own, k + 7] = np.log1p(n_words) / np.log1p(length)
    bucket = (found.hash % np.uint64(_BUCKETS)).astype(np.int64)
    out[:, k + 8 :] = np.bincount(passage * _BUCKETS + bucket, minlength=n * _BUCKETS).reshape(n, _BUCKETS)
    out[own, k + 8 :] /= n_words[:, None]
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class AttentionModel:
    """Encoder, gated attention and score; ``fit`` learns all of them by gradient descent."""

    def __init__(self, n_features: int = N_FEATURES, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda rows, columns: rng.normal(0, rows**-0.5, (rows, columns))
        self.mean, self.scale = np.zeros(n_features), np.ones(n_features)
        self.p = {
            "encode": draw(n_features, _HIDDEN), "encode0": np.zeros(_HIDDEN),
            "signal": draw(_HIDDEN, _GATE), "gate": draw(_HIDDEN, _GATE), "attend": draw(_GATE, 1)[:, 0],
            "score": draw(_HIDDEN, 1)[:, 0], "score0": np.zeros(1),
        }
        self.seed = seed

    def _forward(self, x: np.ndarray, first: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["encode"] + p["encode0"])
        signal, gate = np.tanh(h @ p["signal"]), _sigmoid(h @ p["gate"])
        a = (signal * gate) @ p["attend"]
        rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(a - np.maximum.reduceat(a, first[:-1])[rows])
        weight = e / np.add.reduceat(e, first[:-1])[rows]
        z = np.add.reduceat(weight[:, None] * h, first[:-1])
        return {"h": h, "signal": signal, "gate": gate, "rows": rows, "weight": weight, "z": z, "logit": z @ p["score"] + p["score0"]}

    def _gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self._forward(x, first)
        d_logit = (_sigmoid(f["logit"]) - y) / len(y)
        d_z = d_logit[:, None] * p["score"]
        d_h = f["weight"][:, None] * d_z[f["rows"]]
        d_weight = (f["h"] * d_z[f["rows"]]).sum(1)
        mean = np.add.reduceat(f["weight"] * d_weight, first[:-1])
        d_a = f["weight"] * (d_weight - mean[f["rows"]])
        d_signal = d_a[:, None] * p["attend"] * f["gate"] * (1 - f["signal"] ** 2)
        d_gate = d_a[:, None] * p["attend"] * f["signal"] * f["gate"] * (1 - f["gate"])
        d_h += d_signal @ p["signal"].T + d_gate @ p["gate"].T
        d_in = d_h * (1 - f["h"] ** 2)
        return {
            "encode": x.T @ d_in, "encode0": d_in.sum(0), "signal": f["h"].T @ d_signal, "gate": f["h"].T @ d_gate,
            "attend": (f["signal"] * f["gate"]).T @ d_a, "score": f["z"].T @ d_logit, "score0": d_logit.sum(keepdims=True),
        }

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 30, batch: int = 64, rate: float = 0.004, decay: float = 1e-4):
        """Adam over shuffled bags. Without bags the model stays as drawn; with one class it learns that class."""
        if not bags:
            return self
        everything = np.concatenate(bags)
        self.mean, self.scale = everything.mean(0), everything.std(0) + 1e-6
        bags = [(b - self.mean) / self.scale for b in bags]
        rng = np.random.default_rng(self.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, steps = 0, epochs * -(-len(bags) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(bags))
            for at in range(0, len(order), batch):
                chosen = order[at : at + batch]
                first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in chosen])))
                gradients = self._gradients(np.concatenate([bags[i] for i in chosen]), first, y[chosen])
                step += 1
                now = rate * (1 - step / (steps + 1))
                for k, g in gradients.items():
                    g = g + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def scores(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each bag's score and the attention of each of its passages."""
        f = self._forward((x - self.mean) / self.scale, first)
        return _sigmoid(f["logit"]), f["weight"]


def train(examples: DataFrame, at_most_passages: int = SAMPLE_PASSAGES) -> AttentionModel:
    """Fit on labelled (doc_id, text, label) rows, which the caller has bounded in number.

    Features, not texts, come to the driver, and documents only as long as ``at_most_passages`` are not
    passed, in the order of a hash of their id.
    """

    def describe(batch: pa.RecordBatch):
        bags, counts = [], []
        for chunk in chunks(batch.column(0)):
            x, first = passages(chunk)
            bags += [b.tobytes() for b in np.split(x, first[1:-1])]
            counts += np.diff(first).tolist()
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(bags, pa.binary()), pa.array(counts, pa.int64())], names=["doc_id", "label", "bag", "n"])

    described = map_batches(examples.select("text", "doc_id", "label"), describe, "doc_id long, label int, bag binary, n long")
    bags, y, total = [], [], 0
    for row in described.selectExpr("*", "xxhash64(doc_id) AS _o").orderBy("_o", "doc_id", "bag").toLocalIterator():
        total += row["n"]
        if total > at_most_passages and bags:
            break
        bags.append(np.frombuffer(row["bag"], np.float32).reshape(-1, N_FEATURES).astype(np.float64))
        y.append(float(row["label"]))
    return AttentionModel().fit(bags, np.array(y))


def score(docs: DataFrame, model: AttentionModel) -> DataFrame:
    """``docs`` with ``score``, ``top_passage`` and ``top_weight`` of every whole text.

    ``top_passage`` is the number of the passage with the most attention (the first of equals) and
    ``top_weight`` its share. Empty and NULL texts are scored as one empty passage. Rows stay as they are;
    columns with the outputs' names are replaced.
    """
    docs = docs.drop("score", "top_passage", "top_weight")
    at_text = docs.columns.index("text")
    added = T.StructType.fromDDL("score double, top_passage int, top_weight double")
    schema = T.StructType([*docs.schema.fields, *added.fields])

    def run(batch: pa.RecordBatch):
        for chunk in chunks(batch.column(at_text)):
            x, first = passages(chunk)
            scores, weight = model.scores(x, first)
            top = [int(np.argmax(w)) for w in np.split(weight, first[1:-1])]
            rows = batch.slice(chunk.first, chunk.rows)
            outputs = [pa.array(scores), pa.array(top, pa.int32()), pa.array(weight[first[:-1] + top])]
            yield pa.RecordBatch.from_arrays([*rows.columns, *outputs], names=schema.names)

    return map_batches(docs, run, schema)

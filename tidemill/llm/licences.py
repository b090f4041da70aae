"""Licence notices in documents, by a trained paragraph classifier that templates confirm.

Texts are cut into paragraphs (lines; long ones in overlapping windows). A multinomial logistic regression over
hashed word 1- to 3-grams gives each a family or *unknown*. It is trained here: on the templates and random
variations of them, on licence talk of no known family, and on paragraphs of a bounded sample of the corpus
that resemble no template. Its probabilities are calibrated by a temperature on variations it has not seen. A
family counts only if its probability is high enough and the paragraph shares enough with one of its templates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm.text import NOT_ALPHANUMERIC, Chunk, Words, chunks, map_batches, mix, powers, words

SAMPLE_DOCUMENTS = 400
LEAST_PROBABILITY = 0.5
LEAST_SHARED = 0.5
WINDOW = 48
UNKNOWN = "unknown"

_BITS = 15
_GRAMS = 3

# Wordings of public licence notices, by family. Licence texts and common ways to refer to them.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache 2.0 license.",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "Released under the GPL v3.",
    ),
    "LGPL": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
}

# Licence talk that names no family above.
OTHER_NOTICES = (
    "All rights reserved. No part of this publication may be reproduced without the written permission of the publisher.",
    "Licensed under the terms agreed with the customer.",
    "This work is licensed to the subscriber for personal use only.",
    "Released under an internal license, version 2.0.",
    "You need a license to use this product. See the terms for details.",
    "The license plate and the driver license were issued by the state.",
    "This software is proprietary. Copying and distribution are prohibited.",
    "The general public is invited to this work, free of charge.",
    "Copyright by the authors. Distributed with permission of the copyright holder.",
    "The commission granted a license to the foundation under certain conditions.",
)

FAMILIES = (*sorted(TEMPLATES), UNKNOWN)


def _paragraphs(chunk: Chunk) -> tuple[Words, np.ndarray, np.ndarray]:
    """The chunk's words, and the first and last word (exclusive) of every paragraph, windows included."""
    found = words(chunk, separators=NOT_ALPHANUMERIC)
    none = np.zeros(0, np.int64)
    if not len(found.hash):
        return found, none, none
    line = np.cumsum(chunk.bytes == 0x0A)[found.start]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (found.row[1:] != found.row[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(line))
    # Long lines: windows that overlap by half, the last one reaching to the end.
    steps = np.maximum(1, -(-(end - begin - WINDOW // 2) // (WINDOW // 2)))
    of = np.repeat(np.arange(len(begin)), steps)
    step = np.arange(len(of)) - np.repeat(np.cumsum(steps) - steps, steps)
    low = begin[of] + step * (WINDOW // 2)
    return found, low, np.minimum(low + WINDOW, end[of])


def _features(found: Words, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 1- to 3-grams of paragraphs as (paragraph, feature); each distinct one counts once."""
    weights = powers(_GRAMS + 1)
    owners, features = [], []
    size = high - low
    owner = np.repeat(np.arange(len(low)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + low[owner]
    for n in range(1, _GRAMS + 1):
        fits = at + n <= high[owner]
        start = at[fits]
        total = np.zeros(len(start), np.uint64)
        for j in range(n):
            total += found.hash[start + j] * weights[j]
        owners.append(owner[fits])
        features.append((mix(total + np.uint64(n)) >> np.uint64(64 - _BITS)).astype(np.int64))
    pair = np.unique((np.concatenate(owners) << _BITS) + np.concatenate(features)) if owners else np.zeros(0, np.int64)
    return pair >> _BITS, pair & (1 << _BITS) - 1


def _grams(found: Words, low: int, high: int) -> set:
    """Words and word pairs of one paragraph, for the comparison with templates."""
    own = found.hash[low:high].tolist()
    return {*own, *zip(own, own[1:])}


def _text_grams(text: str) -> set:
    found, low, high = _paragraphs(next(chunks(pa.array([text], pa.string()))))
    return _grams(found, 0, len(found.hash))


class Classifier:
    """Weights of the families, their temperature, and the templates."""

    def __init__(self, seed: int = 11):
        self.seed = seed
        self.weights = np.zeros((1 << _BITS, len(FAMILIES)), np.float32)
        self.bias = np.zeros(len(FAMILIES))
        self.temperature = 1.0
        self.templates = {name: [_text_grams(t) for t in texts] for name, texts in TEMPLATES.items()}

    def shared(self, grams: set, family: str) -> float:
        """The largest share of a paragraph's, or a template's, words and pairs that the two have in common."""
        return max((2 * len(grams & t) / (len(grams) + len(t)) if len(grams) < len(t) else len(grams & t) / len(t) for t in self.templates[family]), default=0.0)

    def resembles_any(self, grams: set) -> bool:
        return any(self.shared(grams, name) >= LEAST_SHARED for name in TEMPLATES)

    def logits(self, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        sums = np.zeros((n, len(FAMILIES)))
        if len(owner):
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            sums[owner[first]] = np.add.reduceat(self.weights[feature], first, axis=0)
        size = np.maximum(1, np.bincount(owner, minlength=n))
        return sums / np.sqrt(size)[:, None] + self.bias

    def probabilities(self, owner, feature, n) -> np.ndarray:
        z = self.logits(owner, feature, n) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, corpus_paragraphs: list[str], epochs: int = 25) -> Classifier:
        """Gradient descent on templates, their variations and the unknown class."""
        rng = np.random.default_rng(self.seed)
        filler = [w for p in corpus_paragraphs[:200] for w in p.split()] or ["text"]
        texts, y = [], []

        def vary(text: str) -> str:
            own = text.split()
            keep = [w for w in own if rng.random() > 0.1] or own
            if len(keep) > 12 and rng.random() < 0.5:  # a notice that a line break cut
                at = rng.integers(0, len(keep) - 8)
                keep = keep[at : at + int(rng.integers(8, len(keep)))]
            extra = [str(filler[i]) for i in rng.integers(0, len(filler), rng.integers(0, 8))]
            return " ".join([*extra, *keep] if rng.random() < 0.5 else [*keep, *extra])

        for label, name in enumerate(FAMILIES):
            for text in TEMPLATES.get(name, OTHER_NOTICES):
                texts += [text, *(vary(text) for _ in range(40))]
                y += [label] * 41
        texts += corpus_paragraphs
        y += [len(FAMILIES) - 1] * len(corpus_paragraphs)
        sets = []
        for text in texts:
            found, _, _ = _paragraphs(next(chunks(pa.array([text], pa.string()))))
            sets.append(_features(found, np.array([0]), np.array([len(found.hash)]))[1])
        y = np.array(y)
        held = rng.random(len(y)) < 0.2
        learn, check = np.flatnonzero(~held), np.flatnonzero(held)
        squares = np.full_like(self.weights, 1e-6)

        def rows(some):
            size = [len(sets[i]) for i in some]
            return np.repeat(np.arange(len(some)), size), np.concatenate([sets[i] for i in some]) if len(some) else np.zeros(0, np.int64)

        for _ in range(epochs):
            for some in np.array_split(rng.permutation(learn), max(1, len(learn) // 64)):
                owner, feature = rows(some)
                p = self.probabilities(owner, feature, len(some))
                p[np.arange(len(some)), y[some]] -= 1
                size = np.maximum(1, np.bincount(owner, minlength=len(some)))
                at, back = np.unique(feature, return_inverse=True)
                g = np.zeros((len(at), len(FAMILIES)), np.float32)
                np.add.at(g, back, (p / np.sqrt(size)[:, None])[owner].astype(np.float32))
                squares[at] += g * g
                self.weights[at] -= 0.3 * g / np.sqrt(squares[at]) + 1e-5 * self.weights[at]
                self.bias -= 0.05 * p.mean(0)
        owner, feature = rows(check)
        z = self.logits(owner, feature, len(check))
        grid = np.geomspace(0.25, 8, 26)
        loss = []
        for t in grid:
            s = z / t
            loss.append((np.log(np.exp(s - s.max(1, keepdims=True)).sum(1)) + s.max(1) - s[np.arange(len(check)), y[check]]).mean())
        self.temperature = float(grid[int(np.argmin(loss))])
        return self


def train(docs: DataFrame, at_most: int = SAMPLE_DOCUMENTS) -> Classifier:
    """A classifier whose unknown class is learned from paragraphs of up to ``at_most`` documents, chosen by
    a hash of their id; paragraphs that resemble a template are left out."""
    model = Classifier()
    chosen = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(at_most)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi")

    def cut(batch: pa.RecordBatch):
        for chunk in chunks(batch.column(0)):
            found, low, high = _paragraphs(chunk)
            # A few of each text: they are alike.
            first = np.searchsorted(found.row[low], np.arange(chunk.rows + 1))
            out = []
            for r in range(chunk.rows):
                for i in range(first[r], min(first[r + 1], first[r] + 10)):
                    if not model.resembles_any(_grams(found, low[i], high[i])):
                        out.append(bytes(chunk.bytes[found.start[low[i]] : found.end[high[i] - 1]]).decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["paragraph"])

    rows = map_batches(sample.select("text"), cut, "paragraph string").collect()
    return model.fit(sorted(r["paragraph"] for r in rows))


NOTICES = "notices array<struct<family: string, probability: double, shared: double, start: int, end: int>>"


def scan(docs: DataFrame, model: Classifier) -> DataFrame:
    """``docs`` with ``notices``: family, calibrated probability, share in common with the closest template
    and byte range of every paragraph that is a licence notice.

    Every paragraph of every whole text is classified. NULL and empty texts, and texts without notices, have
    an empty list. Rows stay as they are; a column named ``notices`` is replaced.
    """
    docs = docs.drop("notices")
    at_text = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(NOTICES).fields])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("shared", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batch: pa.RecordBatch):
        own, notices = shared.value, [[] for _ in range(batch.num_rows)]
        for chunk in chunks(batch.column(at_text), 256 << 10):
            found, low, high = _paragraphs(chunk)
            p = own.probabilities(*_features(found, low, high), len(low))
            best = p.argmax(axis=1) if len(p) else np.zeros(0, np.int64)
            for i in np.flatnonzero((best < len(FAMILIES) - 1) & (p[np.arange(len(p)), best] >= LEAST_PROBABILITY)).tolist():
                family = FAMILIES[best[i]]
                common = own.shared(_grams(found, low[i], high[i]), family)
                if common >= LEAST_SHARED:
                    row = found.row[low[i]]
                    base = chunk.offsets[row]
                    notices[chunk.first + row].append(
                        {"family": family, "probability": float(p[i, best[i]]), "shared": common, "start": int(found.start[low[i]] - base), "end": int(found.end[high[i] - 1] - base)}
                    )
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(notices, kind)], names=schema.names)

    return map_batches(docs, run, schema)

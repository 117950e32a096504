"""Licence scans with a trained paragraph classifier (operator 6).

A paragraph is a line. A multinomial logistic regression on hashed word 1- to
3-grams, trained in numpy on the driver on variations of the templates and on
lines of the corpus, gives each paragraph a licence family or ``none``. The least
probability that names a family is calibrated on held-back variations and lines;
below it a paragraph that looks like a licence is ``unknown``. A named family is
confirmed if one of its templates has enough of its word pairs in the paragraph.

Every paragraph with a word is classified, a block of texts at once. Where no family
can be confirmed, a paragraph is ``unknown`` if a family reaches the least probability.
A notice that is wrapped over lines is found in the lines of up to ``WRAP_WORDS`` words
that follow each other without a blank one, and is one row with its first line.

Defined results: null and empty texts have no paragraphs; repeated rows get equal
results; families of a document are sorted; without documents to sample, ``none``
is trained on shuffled template words alone; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.wordbuf import blocks

#: Notices by which each family is known.
TEMPLATES: dict[str, list[str]] = {
    "agpl": ["This program is licensed under the GNU Affero General Public License, version 3", "Licensed under the AGPL version 3 or later"],
    "apache": ["Licensed under the Apache License, Version 2.0", "You may not use this file except in compliance with the Apache License", "Released under the Apache 2.0 license"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Licensed under the BSD 3-Clause License", "Released under the BSD 2-Clause License"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 License", "Licensed under CC BY-NC 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 License", "Licensed under CC BY-SA 4.0"],
    "cc0": ["This work has been dedicated to the public domain under CC0 1.0 Universal", "Released into the public domain under the Unlicense"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "This program is free software under the terms of the GNU General Public License version 2 or later", "Licensed under the GPL version 3"],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3", "Licensed under the LGPL version 2.1 or later"],
    "mit": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "Licensed under the MPL 2.0"],
    "proprietary": ["All rights reserved", "Copyright, all rights reserved", "Confidential and proprietary, unauthorised copying is prohibited"],
}
#: Names in the short forms (SPDX tags, "License: MIT") of each family.
SHORT = {
    "agpl": ["agpl-3.0", "agpl-3.0-only", "agpl-3.0-or-later", "agpl"], "apache": ["apache-2.0", "apache"], "bsd": ["bsd-3-clause", "bsd-2-clause", "bsd"], "cc-by": ["cc-by-4.0"], "cc-by-nc": ["cc-by-nc-4.0"],
    "cc-by-sa": ["cc-by-sa-4.0"], "cc0": ["cc0-1.0", "cc0", "unlicense"], "gpl": ["gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "gpl-2.0", "gpl-2.0-only", "gpl-2.0-or-later", "gplv3", "gplv2", "gpl"],
    "lgpl": ["lgpl-2.1", "lgpl-2.1-only", "lgpl-2.1-or-later", "lgpl-3.0", "lgpl-3.0-only", "lgpl-3.0-or-later", "lgpl"], "mit": ["mit"], "mpl": ["mpl-2.0", "mpl"], "proprietary": ["proprietary"],
}
for _family, _names in SHORT.items():
    TEMPLATES[_family] += [f"{lead}: {name}" for name in _names for lead in ("SPDX-License-Identifier", "License", "Licence")]
NONE, UNKNOWN = "none", "unknown"
#: Words of consecutive lines that are read as one paragraph.
WRAP_WORDS = 40
FEATURES, LEAST_SHARE, LEAST_PAIRS = 1 << 14, 0.6, 2
#: Lines of documents that stand for paragraphs without a licence, and rows that give them, at most.
MODEL_LINES, MODEL_ROWS = 500, 100
BLOCK_BYTES = 2_000_000
#: Words whose hashes a task keeps.
WORD_CACHE = 500_000
#: Words or the end of a line, of lower-cased text.
TOKEN = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*|\n")
WORD = re.compile(r"[a-z0-9]+(?:[.\-][a-z0-9]+)*")


def words_of(line: str) -> list[str]:
    return WORD.findall(line.lower())


def pairs_of(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


def gram_ids(h: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and feature of the different 1- to 3-grams of each line; ``h`` has the words' hashes, ``line`` their lines in order."""
    h = h.astype(np.uint64)
    keys, g = [], np.zeros(len(h), np.uint64)
    for n in (1, 2, 3):
        if len(h) < n:
            break
        g = (g[: len(h) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) + h[n - 1 :] + np.uint64(n)
        mixed = (g ^ (g >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)
        same = line[: len(g)] == line[n - 1 :]
        keys.append(line[: len(g)][same] * np.int64(FEATURES) + (mixed[same] % np.uint64(FEATURES)).astype(np.int64))
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found // FEATURES, found % FEATURES


def features(words: list[str]) -> np.ndarray:
    h = np.array([xxhash.xxh32_intdigest(w) for w in words], np.int64)
    return gram_ids(h, np.zeros(len(h), np.int64))[1]


class LicenceModel:
    """Weights [feature, class], the calibrated threshold, and the templates' word pairs."""

    def __init__(self, lines: list[str], seed: int = 11) -> None:
        self.families = [*sorted(TEMPLATES), NONE]
        self.pairs = {f: [pairs_of(words_of(t)) for t in TEMPLATES[f]] for f in TEMPLATES}
        rng = np.random.default_rng(seed)
        noise = np.array([w for line in lines for w in words_of(line)] or ["it", "was", "here"])
        x: list[np.ndarray] = []
        y: list[int] = []
        for k, family in enumerate(self.families[:-1]):
            for template in TEMPLATES[family]:
                words = words_of(template)
                for _ in range(30):  # words lost, and others before and after
                    kept = [w for w in words if rng.random() > 0.08] or words
                    before, after = (rng.choice(noise, rng.integers(0, 12)).tolist() for _ in range(2))
                    x.append(features([*before, *kept, *after]))
                    y.append(k)
        common = np.array([w for f in TEMPLATES.values() for t in f for w in words_of(t)])
        others = [words_of(line) for line in lines] + [rng.choice(common, rng.integers(3, 12)).tolist() for _ in range(300)]
        for words in others:
            if words and not any(self.confirms(f, words) for f in TEMPLATES):
                x.append(features(words))
                y.append(len(self.families) - 1)
        labels = np.array(y)
        back = rng.random(len(x)) < 0.2
        self.weights = np.zeros((FEATURES, len(self.families)))
        total = np.full_like(self.weights, 1e-8)
        order = np.flatnonzero(~back)
        for _ in range(5):
            rng.shuffle(order)
            for i in order.tolist():
                p = self.probabilities(x[i])
                p[labels[i]] -= 1
                ids = x[i]
                total[ids] += p**2
                self.weights[ids] -= 0.3 * p / np.sqrt(total[ids])
        # the least probability that leaves one in a hundred held-back lines without a licence named
        none = len(self.families) - 1
        wrong = [float(np.delete(self.probabilities(x[i]), none).max()) for i in np.flatnonzero(back & (labels == none))]
        self.least = max(0.5, float(np.quantile(wrong, 0.99))) if wrong else 0.5

    def probabilities(self, ids: np.ndarray) -> np.ndarray:
        z = self.weights[ids].sum(axis=0)
        p = np.exp(z - z.max())
        return p / p.sum()

    def confirms(self, family: str, words: list[str]) -> bool:
        mine = pairs_of(words)
        return any(len(t & mine) >= LEAST_SHARE * len(t) for t in self.pairs[family])

    def share(self, family: str, words: list[str]) -> float:
        """The largest share of a template's word pairs that the words hold."""
        mine = pairs_of(words)
        return max(len(t & mine) / len(t) for t in self.pairs[family])

    def classify(self, line: str) -> tuple[str, float]:
        """Family, ``unknown`` or ``none``, with its probability."""
        words = words_of(line)
        p = self.probabilities(features(words))
        best = int(np.argmax(p))
        if self.families[best] == NONE and p[best] >= self.least:
            return NONE, float(p[best])
        if self.families[best] != NONE and p[best] >= self.least and self.confirms(self.families[best], words):
            return self.families[best], float(p[best])
        return UNKNOWN, float(1 - p[-1])

    def likely_lines(self, texts: list[str], seen: dict[str, int]) -> tuple[list[set[int]], list[set[int]]]:
        """Of each text the lines that are not surely ``none``, and those with a word pair of a template, also over the line's end; ``seen`` keeps words' hashes."""
        h: list[int] = []
        line: list[int] = []
        first = [0]
        at = 0
        for text in texts:
            for w in TOKEN.findall(text.lower()):
                if w == "\n":
                    at += 1
                    continue
                if (x := seen.get(w)) is None:
                    x = seen[w] = xxhash.xxh32_intdigest(w)
                h.append(x)
                line.append(at)
            at += 1
            first.append(at)
        out: list[set[int]] = [set() for _ in texts]
        touched: list[set[int]] = [set() for _ in texts]
        if not h:
            return out, touched
        hashes, of = np.array(h, np.int64), np.array(line, np.int64)
        wanted = np.array(sorted({xxhash.xxh32_intdigest(a) << 31 ^ xxhash.xxh32_intdigest(b) for f in self.pairs.values() for t in f for a, b in t}), np.int64)
        pair = np.flatnonzero(np.isin(hashes[:-1] << 31 ^ hashes[1:], wanted))
        near = np.unique(np.concatenate([of[pair], of[pair + 1]]))
        for d, x in zip((np.searchsorted(first, near, "right") - 1).tolist(), near.tolist(), strict=True):
            touched[d].add(x - first[d])
        lines, ids = gram_ids(hashes, of)
        starts = np.flatnonzero(np.diff(lines, prepend=-1))
        z = np.add.reduceat(self.weights.astype(np.float32)[ids], starts, axis=0)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        clear = (p[:, :-1].max(axis=1) > self.least - 1e-3) & (p[:, :-1].max(axis=1) >= p[:, -1] - 1e-3)
        hit = lines[starts][clear]
        owner = np.searchsorted(first, hit, "right") - 1
        for d, x in zip(owner.tolist(), hit.tolist(), strict=True):
            out[d].add(x - first[d])
        return out, touched

    def pair_hashes(self) -> set[int]:
        return {xxhash.xxh64_intdigest(" ".join(p)) for f in self.pairs.values() for t in f for p in t}


def train(docs: DataFrame) -> LicenceModel:
    """A model with lines of the first documents in hash order as far as the bounds go."""
    chosen = docs.select(F.xxhash64(F.col("doc_id")).alias("rank"), "doc_id").orderBy("rank", "doc_id").limit(MODEL_ROWS)
    ids = [r["doc_id"] for r in chosen.collect()]  # MODEL_ROWS at most
    lines: list[str] = []
    for r in docs.select("doc_id", "text").filter(F.col("doc_id").isin(ids)).orderBy("doc_id", "text").limit(2 * MODEL_ROWS).toLocalIterator():
        lines += [x for x in (r["text"] or "").split("\n") if x.strip()][: MODEL_LINES - len(lines)]
    return LicenceModel(lines)


SPANS = "doc_id long, line int, start long, length long, family string, probability double"


def scan(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """A row for each paragraph that is licence-like: where it is (line, first code point, length), its family and probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES times families

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        none = len(model.families) - 1
        seen: dict[str, int] = {}
        source = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True))
        for held in blocks(source, BLOCK_BYTES):
            texts = [(t or b"").decode() for _, t in held]
            likely, touched = model.likely_lines(texts, seen)
            if len(seen) > WORD_CACHE:
                seen.clear()
            rows: list[tuple] = []
            for (doc_id, _), text, flagged, near in zip(held, texts, likely, touched, strict=True):
                if not flagged and not near:
                    continue
                lines = text.split("\n")
                said = {i: words_of(lines[i]) for i in sorted(flagged | near)}
                starts = np.cumsum([0, *(len(x) + 1 for x in lines)]).tolist()
                named: set[int] = set()
                found: dict[int, tuple] = {}
                for i, words in said.items():
                    mine = pairs_of(words)
                    close = len(words) > LEAST_PAIRS and any(len(t & mine) >= min(LEAST_PAIRS, len(t)) for f in model.pairs.values() for t in f)
                    if not close and i not in flagged:
                        continue
                    family, p = model.classify(lines[i])
                    if family == UNKNOWN and not close:  # nothing can be confirmed: only a clear family makes it unknown
                        q = model.probabilities(features(words))
                        family = UNKNOWN if int(np.argmax(q)) != none and q.max() >= model.least else NONE
                    if family != NONE:
                        found[i] = (doc_id, i, starts[i], len(lines[i]), family, p)
                        if family != UNKNOWN:
                            named.add(i)
                done = 0
                for i in sorted(near):  # notices over several lines: their first and last lines have a template's word pair
                    words, j, best = list(said[i]), i + 1, 0.0
                    if i < done:
                        continue
                    while i not in named and j < len(lines) and lines[j].strip() and j not in named:
                        more = said[j] if j in said else words_of(lines[j])
                        if len(words) + len(more) > WRAP_WORDS:
                            break
                        words += more
                        j += 1
                        if j - 1 not in near or not any(model.confirms(f, words) for f in TEMPLATES):
                            continue
                        family, p = model.classify(" ".join(words))
                        if family not in (NONE, UNKNOWN) and (share := model.share(family, words)) > best:
                            best = share  # a further line is taken in if it holds more of the notice
                            for k in range(i, j):
                                found.pop(k, None)
                            found[i] = (doc_id, i, starts[i], starts[j] - 1 - starts[i], family, p)
                            done = j
                rows += [found[k] for k in sorted(found)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64()), strict=True)], names=["doc_id", "line", "start", "length", "family", "probability"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SPANS)


def licences(docs: DataFrame, model: LicenceModel) -> DataFrame:
    """Of each doc_id: its confirmed families, and how many paragraphs are confirmed or unknown."""
    found = scan(docs, model).groupBy("doc_id").agg(
        F.array_sort(F.collect_set(F.when(F.col("family") != UNKNOWN, F.col("family")))).alias("families"),
        F.count_if(F.col("family") != UNKNOWN).alias("n_confirmed"),
        F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"),
        F.max(F.when(F.col("family") != UNKNOWN, F.col("probability"))).alias("probability"),
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    joined = ids.join(found.withColumnRenamed("doc_id", "found_id"), F.col("doc_id").eqNullSafe(F.col("found_id")), "left")
    return joined.select("doc_id", F.coalesce(F.array_join("families", ","), F.lit("")).alias("families"), F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"), F.coalesce("n_unknown", F.lit(0)).alias("n_unknown"), F.coalesce("probability", F.lit(0.0)).alias("probability"))

"""Toxicity by subword-bag embeddings and a linear softmax (operator 10).

A word is a bag of hashed character n-grams; a passage of ``PASSAGE`` words is the
average of its words' embeddings, and a linear softmax classifies it. Embeddings
and softmax are trained together in numpy on the driver, first on all passages of
labelled documents, then on the passages that score highest in theirs, because a
toxic document needs one toxic passage. The score of a document is that of its
highest passage, calibrated on documents that were held back from the training.
As the softmax is linear, a word's contribution is a sum over its n-grams, so
that workers need one number per bucket.

Defined results: null and empty texts have no words and get the score of an
empty passage; passages do not overlap and the last is padded; repeated labels of
a document count once, as toxic if any says so; without labels of both kinds every
score is 0; rows that share a doc_id are scored one by one, and equal texts alike; a
null doc_id has no label; very long texts are blocks of their own; a column named
score is replaced, others pass through; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm.langid import sample
from ticketloom.llm.wordbuf import WordBuffer, blocks, mix

#: Labelled documents of each kind that the model is trained on, whole, at most.
MODEL_ROWS = {1: 1500, 0: 2500}
BUCKETS, DIM, PASSAGE = 1 << 16, 8, 2
#: Passages of a clean document that a later epoch trains on: those that score highest.
HARD = 4
NGRAMS = (3, 4, 5, 6)
BLOCK_BYTES = 1_500_000
PLAIN = np.zeros(256, bool)  # bytes that words are stripped of at their ends
PLAIN[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
U64 = np.uint64


def subwords(buffer: WordBuffer, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of some words of a buffer, and where those of each word begin (one more at the end)."""
    starts, ends = buffer.starts[words].copy(), buffer.ends[words].copy()
    while len(more := np.flatnonzero((starts < ends) & PLAIN[buffer.bytes[starts]])):
        starts[more] += 1
    while len(more := np.flatnonzero((starts < ends) & PLAIN[buffer.bytes[ends - 1]])):
        ends[more] -= 1
    sizes = ends - starts
    # all words with an edge mark at either end, one after another
    first = np.cumsum(sizes + 2) - sizes - 2
    total = int((sizes + 2).sum())
    data = np.full(total, 1, np.uint8)
    inside = np.repeat(starts - first - 1, sizes + 2) + np.arange(total)
    place = np.arange(total) - np.repeat(first, sizes + 2)
    mid = (place > 0) & (place <= np.repeat(sizes, sizes + 2))
    data[mid] = buffer.bytes[inside[mid]]
    left = np.repeat(sizes + 2, sizes + 2) - place
    owner = np.repeat(np.arange(len(sizes)), sizes + 2)
    found, whose = [], []
    for n in NGRAMS:
        at = np.flatnonzero((left >= n) & (np.repeat(sizes, sizes + 2) > 0))
        code = np.full(len(at), n, np.uint64)
        for k in range(n):
            code = code << U64(8) | data[at + k].astype(np.uint64)
        found.append((mix(code) % U64(BUCKETS)).astype(np.int32))
        whose.append(owner[at])
    ids, whose = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(whose, kind="stable")
    return ids[order], np.searchsorted(whose[order], np.arange(len(sizes) + 1))


class Bags:
    """Texts as passages of words, and words as bags of buckets."""

    def __init__(self, texts: list[bytes | None]) -> None:
        buffer = WordBuffer(texts, lower=True)
        _, one, self.word = np.unique(buffer.word_hashes(0), return_index=True, return_inverse=True)
        self.ids, self.bounds = subwords(buffer, one)
        n = buffer.n_words
        passages = np.maximum(1, -(-n // PASSAGE))
        self.first = np.cumsum(passages) - passages  # first passage of each text
        self.n_passages = int(passages.sum())
        place = np.arange(len(self.word)) - np.repeat(buffer.first[:-1], n)
        self.passage = np.repeat(self.first, n) + place // PASSAGE  # of each word

    def word_means(self, values: np.ndarray) -> np.ndarray:
        """Mean of the buckets' values for each different word."""
        n = np.diff(self.bounds)
        out = np.zeros((len(n), *values.shape[1:]), np.float64)
        some = np.flatnonzero(n > 0)
        if len(some):
            out[some] = np.add.reduceat(values[self.ids], self.bounds[some], axis=0) / (n[some] if values.ndim == 1 else n[some, None])
        return out


class ToxicModel:
    """One number for each bucket, and the calibration of the highest passage."""

    def __init__(self) -> None:
        self.value, self.bias, self.slope, self.shift = np.zeros(BUCKETS), 0.0, 0.0, -50.0

    def passages(self, bags: Bags) -> np.ndarray:
        word = bags.word_means(self.value)
        return self.bias + np.bincount(bags.passage, word[bags.word], bags.n_passages) / PASSAGE

    def highest(self, bags: Bags) -> np.ndarray:
        return np.maximum.reduceat(self.passages(bags), bags.first)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = self.slope * self.highest(Bags(texts)) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(texts: list[bytes], labels: np.ndarray, seed: int = 7, epochs: tuple[int, int] = (2, 10)) -> ToxicModel:
    """Embeddings and softmax, by Adagrad on passages."""
    model = ToxicModel()
    if len(set(labels.tolist())) < 2:
        return model
    rng = np.random.default_rng(seed)
    bags = Bags(texts)
    text_of = np.repeat(np.arange(len(texts)), np.diff(np.append(bags.first, bags.n_passages)))
    back = rng.random(len(texts)) < 0.2  # held back for the calibration
    order = np.argsort(bags.passage, kind="stable")
    words, word_bounds = bags.word[order], np.searchsorted(bags.passage[order], np.arange(bags.n_passages + 1))
    embed, weight, bias = rng.normal(0, 0.3, (BUCKETS, DIM)), rng.normal(0, 0.3, (DIM, 2)), np.zeros(2)
    sums = [np.full_like(embed, 1e-12), np.full_like(weight, 1e-12), np.full_like(bias, 1e-12)]

    def spread(items: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions between the bounds of each item, and whose they are."""
        n = bounds[items + 1] - bounds[items]
        who = np.repeat(np.arange(len(items)), n)
        return np.arange(len(who)) + np.repeat(bounds[items] - np.cumsum(n) + n, n), who

    def step(batch: np.ndarray, rate: float) -> None:
        nonlocal embed, weight, bias
        at, passage = spread(batch, word_bounds)
        mine, local = np.unique(words[at], return_inverse=True)
        grams, gram_word = spread(mine, bags.bounds)
        ids = bags.ids[grams]
        n = np.maximum(1, bags.bounds[mine + 1] - bags.bounds[mine])
        vectors = np.stack([np.bincount(gram_word, embed[ids, d], len(mine)) for d in range(DIM)], 1) / n[:, None]
        x = np.stack([np.bincount(passage, vectors[local, d], len(batch)) for d in range(DIM)], 1) / PASSAGE
        z = x @ weight + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(batch)), labels[text_of[batch]]] -= 1
        p /= len(batch)
        d_weight, d_bias, d_x = x.T @ p, p.sum(axis=0), p @ weight.T
        d_word = np.stack([np.bincount(local, d_x[passage, d], len(mine)) for d in range(DIM)], 1) / (PASSAGE * n[:, None])
        used, slot = np.unique(ids, return_inverse=True)
        d_embed = np.stack([np.bincount(slot, d_word[gram_word, d], len(used)) for d in range(DIM)], 1)
        for value, total, grad, where in ((embed, sums[0], d_embed, used), (weight, sums[1], d_weight, slice(None)), (bias, sums[2], d_bias, slice(None))):
            total[where] += grad**2
            value[where] -= rate * grad / np.sqrt(total[where])

    def scores() -> np.ndarray:
        model.value, model.bias = embed @ (weight[:, 1] - weight[:, 0]), float(bias[1] - bias[0])
        return model.passages(bags)

    train = np.flatnonzero(~back[text_of])
    for epoch in range(sum(epochs)):
        if epoch < epochs[0]:
            chosen = train
            few = labels[text_of[chosen]] == 1
            chosen = np.concatenate([chosen[few], rng.choice(chosen[~few], min(int((~few).sum()), 3 * int(few.sum()) + 200), replace=False)])
        else:
            z = scores()
            top = np.lexsort((-z, text_of))
            rank = np.arange(len(top)) - np.searchsorted(text_of[top], text_of[top])
            most = np.where(labels[text_of[top]] == 1, 1, HARD)
            top = top[~back[text_of[top]] & (rank < most)]
            rest = train[labels[text_of[train]] == 0]
            chosen = np.concatenate([top, rng.choice(rest, min(len(rest), HARD * len(texts)), replace=False)])
        rng.shuffle(chosen)
        for i in range(0, len(chosen), 256):
            step(chosen[i : i + 256], 0.2)
    z = np.maximum.reduceat(scores(), bags.first)
    test = back if len(set(labels[back].tolist())) == 2 else np.ones(len(texts), bool)
    x, y = z[test], labels[test]
    pos, neg = np.sort(x[y == 1]), np.sort(x[y == 0])
    scale = max(1e-6, float(np.median(pos) - np.median(neg)))
    # the threshold with the least errors on them (a clean share weighs three times a toxic one), amid its neighbours
    cuts = np.unique(x)
    cuts = np.concatenate([cuts[:1] - scale, (cuts[1:] + cuts[:-1]) / 2, cuts[-1:] + scale])
    wrong = np.searchsorted(pos, cuts, "left") / len(pos) + 3 - 3 * np.searchsorted(neg, cuts, "left") / len(neg)
    best = cuts[wrong <= wrong.min() + 1e-12]
    model.slope = 8 / scale
    model.shift = -model.slope * float((best[0] + best[-1]) / 2)
    return model


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """A model of labelled documents: of each kind those first in hash order, as far as the bounds go."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).filter("toxic in (0, 1)")
    chosen = sample(known, "toxic", F.when(F.col("toxic") == 1, MODEL_ROWS[1]).otherwise(MODEL_ROWS[0]))
    toxic = {r["doc_id"]: r["toxic"] for r in chosen.collect()}  # MODEL_ROWS at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    wanted = texts.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    held: dict[int, bytes] = {}
    for r in wanted.toLocalIterator():
        held[r["doc_id"]] = max(held.get(r["doc_id"], b""), r["text"].encode())
    ids = sorted(held)
    return fit([held[i] for i in ids], np.array([toxic[i] for i in ids], np.int64))


def score_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """score of each row, beside the columns of ``docs`` (in place of any with this name)."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t,) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            found = [shared.value.score([t for (t,) in held]) for held in blocks(texts, BLOCK_BYTES)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found) if found else np.zeros(0))], names=[*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)

"""Language-model scoring with a probabilistic suffix tree (operator 7).

Tokens are words (A-Z lower-cased, by 64 bits of their XXH3 hash) and one end after
each text. The tree grows from its root a token at a time: a child of a kept context,
that context with one more token before it, is kept if training has it ``LEAST`` times
and its next tokens diverge from the parent's by a likelihood-ratio test. The test is
made on next tokens dealt to ``CELLS`` classes by their hash, which can only lower the
ratio; classes keep what is sent small. A kept context's next tokens are counted in
full, and its distribution is smoothed with its parent's, down to discounted counts
at the root. The state that scores a token is the longest kept context that ends just
before it. All words that training lacks share one symbol, as in the base.

The tree is never gathered: it grows with the corpus, and there is no bound on how
many contexts it has. Texts stay in blocks; a block sends each different key it has
(word, context, context and next token) to a bucket by the key's hash, with what it
adds to the key's sum over training, and gets the sum back. A child is examined where
the tokens before its last are a kept context too, because that is where its count is
known: then none that is too rare is ever asked for. The depth ends where no context grows, at
``deepest`` of the corpus at most. What reaches the driver are totals.

Defined results: a null text is the empty text, one end token; without training
rows every token is unknown; rows that share a doc_id or are equal are scored each
by itself; a null doc_id stays null and is never trained on by op7's condition; very
long texts are blocks of their own; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.wordbuf import WordBuffer, blocks, mix
from ticketloom.session import drop_path, scratch_path

#: Training tokens behind a kept context, at least.
LEAST = 64
#: Classes of next tokens in the test, and the least log-likelihood ratio, in nats: with 15 degrees of freedom, chance gives as much once in a million.
CELLS, DIVERGENCE = 16, 29.0
#: Tokens that the parent's distribution counts for in a child's.
PRIOR = 4.0
#: Bytes of text of which a bucket takes the keys, and of text that a block holds.
BUCKET_BYTES, BLOCK_BYTES = 14_000_000, 7_000_000
NULL_ID = -(1 << 63)
U64 = np.uint64
START, END = U64(0x5851F42D4C957F2D), U64(0x14057B7EF767814F)  # hashes of the start and the end of a text
STEP, PAIR = U64(0x9E3779B97F4A7C15), U64(0xD1342543DE82EF95)

#: A block's texts (bucket -2, written once) and state (-1), or what it asks of a bucket or is told by it; ``open`` counts tokens whose context may grow.
ROWS_DDL = "block long, bucket int, open long, data binary"
ROWS = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("open", pa.int64()), ("data", pa.binary())])


def pack(*parts: np.ndarray, level: int = 1) -> bytes:
    raw = [np.ascontiguousarray(p.view(np.uint8).reshape(len(p), -1).T).tobytes() if len(p) else b"" for p in parts]
    head = np.array([len(parts), *(len(r) for r in raw)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(raw))


def unpack(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8).tolist()
    at, out = 8 * (n + 1), []
    for size, kind in zip(sizes, kinds, strict=True):
        item = np.dtype(kind).itemsize
        part = np.frombuffer(raw, np.uint8, size, at).reshape(item, -1).T
        out.append(np.ascontiguousarray(part).view(kind).ravel() if size else np.zeros(0, kind))
        at += size
    return out


def bucket_edges(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket of ascending hashes begins."""
    return np.searchsorted((h >> U64(32)) * U64(buckets) >> U64(32), np.arange(buckets + 1))


def cell_of(h: np.ndarray) -> np.ndarray:
    """The class of a token in the test."""
    return (h & U64(CELLS - 1)).astype(np.int64)


def deepest(tokens: int, least: int = LEAST) -> int:
    """Tokens in a context at most: as many as a tree that branches ``least`` ways has levels over the corpus, two at least."""
    return max(2, int(math.log(max(tokens, 1)) / math.log(least)))


def root(counts: np.ndarray, tokens: float, types: float, discount: float) -> np.ndarray:
    """Logarithms of the probabilities of tokens by their discounted counts; those that training lacks share the rest."""
    if not tokens:
        return np.zeros(len(counts))
    return np.log(np.where(counts > 0, counts - discount, discount * types) / tokens)


def ratio(cells: np.ndarray, cross: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of contexts: of their next tokens' classes by their own shares against ``cross`` by the parent's."""
    n = cells.sum(axis=1)
    own = (cells * np.log(np.maximum(cells, 1))).sum(axis=1) - n * np.log(np.maximum(n, 1))
    return own - cross


class Block:
    """Texts of a block: per text what is summed up; the words and the tokens; the kept contexts of the open tokens.

    ``flags`` of a token: 1 if it is open, 2 if training has it often enough behind its kept context. Of the open tokens
    ``low`` is the logarithm of the probability so far; ``totals`` and ``shares`` (of the classes) belong to the different
    contexts of the open tokens, in the order of their hashes. ``counts`` are the words' in training; with ``facts`` (tokens,
    types, discount) they stand for ``low`` before the first pairs are known.
    """

    TEXTS = {"ids": np.int64, "train": np.uint8, "n": np.uint32, "words": np.uint64, "index": np.uint32}  # never change
    KINDS = {"known": np.uint32, "base": np.float64, "score": np.float64, "counts": np.uint32, "flags": np.uint8, "facts": np.float64, "low": np.float32, "totals": np.uint32, "shares": np.float32}

    def __init__(self, texts: bytes | None = None, data: bytes | None = None) -> None:
        for kinds, packed in ((self.TEXTS, texts), (self.KINDS, data)):
            for name, part in zip(kinds, unpack(packed, *kinds.values()) if packed else [np.zeros(0, k) for k in kinds.values()], strict=True):
                setattr(self, name, part)
        self.flags = self.flags.copy()

    @classmethod
    def of(cls, held: list[tuple]) -> Block:
        self = cls()
        buffer = WordBuffer([t for *_, t in held], lower=True)
        n = buffer.n_words.astype(np.int64)
        tokens = np.full(int((n + 1).sum()), END)
        inner = np.ones(len(tokens), bool)
        inner[np.cumsum(n + 1) - 1] = False
        tokens[inner] = buffer.word_hashes(0)
        words, index, count = np.unique(tokens, return_inverse=True, return_counts=True)
        often = np.argsort(-count, kind="stable")  # small numbers for common words
        place = np.empty(len(often), np.uint32)
        place[often] = np.arange(len(often), dtype=np.uint32)
        self.words, self.index = words[often], place[index]
        self.ids, self.train = np.array([d for d, *_ in held], np.int64), np.array([x for _, x, _ in held], np.uint8)
        self.n = n.astype(np.uint32)
        self.known, self.base, self.score = np.zeros(len(held), np.uint32), np.zeros(len(held)), np.zeros(len(held))
        self.flags = np.ones(len(tokens), np.uint8)
        return self

    def texts(self) -> bytes:
        return pack(*(np.asarray(getattr(self, name), kind) for name, kind in self.TEXTS.items()), level=6)  # once, read often

    def data(self) -> bytes:
        low = self.low
        if len(self.facts):
            self.low = low[:0]
        packed = pack(*(np.asarray(getattr(self, name), kind) for name, kind in self.KINDS.items()))
        self.low = low
        return packed

    def lay(self) -> None:
        """The tokens in a row, each text behind its start; ``at``, ``doc`` and ``place`` (tokens before it, with the start) of the open ones."""
        n = self.n.astype(np.int64) + 1
        self.doc_of = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
        self.row = np.full(len(self.index) + len(n), START)
        at = np.arange(len(self.index)) + self.doc_of + 1
        self.row[at] = self.words[self.index]
        self.open = np.flatnonzero(self.flags & 1)
        self.at, self.doc = at[self.open], self.doc_of[self.open]
        self.place = self.open - first[self.doc] + 1
        self.use = self.train[self.doc] > 0
        if len(self.facts):
            self.low = root(self.counts[self.index[self.open]].astype(float), *self.facts).astype(np.float32)

    def context(self, depth: int) -> np.ndarray:
        """Hash of the ``depth`` tokens before each open token."""
        h = np.full(len(self.at), U64(depth))
        for d in range(1, depth + 1):
            h = mix(h * STEP + self.row[self.at - d])
        return h

    def close(self, stays: np.ndarray) -> None:
        """Tokens whose context grows no further get the score of their state."""
        gone = ~stays
        self.score = self.score + np.bincount(self.doc[gone], self.low[gone], len(self.n)) / math.log(10)
        self.flags[self.open[gone]] &= 2
        self.low = self.low[stays]


class Words:
    """Step 0: how often training has each token; gives the base, the root, and the contexts of one token."""

    def __init__(self, facts: dict | None = None, least: int = LEAST) -> None:
        self.facts, self.least = facts or {}, least

    asks = (np.uint32,)
    tells = (np.uint32,)

    def ask(self, b: Block) -> tuple[np.ndarray, list[np.ndarray]]:
        order = np.argsort(b.words)
        self.back = np.argsort(order)
        used = np.bincount(b.index, b.train[b.doc_of] > 0, len(b.words))
        return b.words[order], [used[order]]

    def answer(self, sums: list[np.ndarray]) -> list[np.ndarray]:
        return sums

    def tell(self, b: Block, told: list[np.ndarray]) -> None:
        f = self.facts
        b.counts = told[0][self.back]
        count = b.counts[b.index]
        b.facts = np.array([f["tokens"], f["types"], f["discount"]], float)
        b.low = root(count.astype(float), *b.facts).astype(np.float32)
        b.known = np.bincount(b.doc_of, count > 0, len(b.n)).astype(np.uint32)
        b.base = np.bincount(b.doc_of, np.log(count + 0.1) - math.log(f["tokens"] + 0.1 * (f["types"] + 1)), len(b.n)) / math.log(10)
        b.flags = (1 + 2 * (count >= self.least)).astype(np.uint8)
        b.totals, b.shares = np.zeros(1, np.uint32), np.array(f["shares"], np.float32)
        before = np.concatenate([[0], b.flags[:-1] & 2]) > 0
        b.close(np.where(b.place == 1, f["texts"] >= self.least, before[b.open]))


class Screen:
    """Whether the contexts of ``depth`` tokens are kept: their next tokens by class against the parent's shares."""

    def __init__(self, depth: int, least: int, divergence: float) -> None:
        self.depth, self.least, self.divergence = depth, least, divergence

    asks = (np.float32, *[np.uint32] * CELLS)
    tells = (np.uint8, *[np.uint32] * CELLS)

    def ask(self, b: Block) -> tuple[np.ndarray, list[np.ndarray]]:
        keys, one, self.back = np.unique(b.context(self.depth), return_index=True, return_inverse=True)
        parents = np.unique(b.context(self.depth - 1), return_inverse=True)[1] if self.depth > 1 else np.zeros(len(b.at), np.int64)
        self.parent = parents[one]  # of each key: its parent's place
        cell = cell_of(b.row[b.at])
        self.shares = b.shares.reshape(-1, CELLS).astype(float)
        cross = np.bincount(self.back, b.use * np.log(self.shares[parents, cell]), len(keys))
        cells = np.bincount(self.back * CELLS + cell, b.use, len(keys) * CELLS).reshape(-1, CELLS)
        return keys, [cross, *cells.T]

    def answer(self, sums: list[np.ndarray]) -> list[np.ndarray]:
        cells = np.stack(sums[1:], 1)
        kept = (cells.sum(axis=1) >= self.least) & (ratio(cells, sums[0]) >= self.divergence)
        return [kept, *(cells * kept[:, None]).T]

    def tell(self, b: Block, told: list[np.ndarray]) -> None:
        kept = told[0] > 0
        cells = np.stack(told[1:], 1)[kept].astype(float)
        totals = cells.sum(axis=1)
        b.totals = totals.astype(np.uint32)
        b.shares = ((cells + PRIOR * self.shares[self.parent[kept]]) / (totals[:, None] + PRIOR)).astype(np.float32).ravel()
        b.close(kept[self.back])


class Pairs:
    """How often training has each open token behind its kept context; gives the probabilities, and what may grow."""

    def __init__(self, depth: int, least: int, last: bool) -> None:
        self.depth, self.least, self.last = depth, least, last

    asks = (np.uint32,)
    tells = (np.uint32,)

    def ask(self, b: Block) -> tuple[np.ndarray, list[np.ndarray]]:
        context = b.context(self.depth)
        self.which = np.unique(context, return_inverse=True)[1]
        count = b.counts[b.index[b.open]]
        self.ask_for = ask = count > 0  # others are nowhere in training
        keys, self.back = np.unique(mix(context[ask] * PAIR + b.row[b.at[ask]]), return_inverse=True)
        return keys, [np.bincount(self.back, b.use[ask], len(keys))]

    def answer(self, sums: list[np.ndarray]) -> list[np.ndarray]:
        return sums

    def tell(self, b: Block, told: list[np.ndarray]) -> None:
        both, total = np.zeros(len(b.open)), b.totals[self.which].astype(float)
        both[self.ask_for] = told[0][self.back]
        b.low = np.log((both + PRIOR * np.exp(b.low.astype(float))) / (total + PRIOR)).astype(np.float32)
        b.facts = b.facts[:0]
        b.flags &= 1
        b.flags[b.open[both >= self.least]] |= 2
        before = np.concatenate([[0], b.flags[:-1] & 2]) > 0  # the longer context occurs no more often than this pair
        stays = before[b.open] & (b.place > self.depth) & (not self.last)
        if not stays.any():
            b.totals, b.shares = b.totals[:0], b.shares[:0]
        else:  # contexts of the tokens that stay
            used = np.unique(self.which[stays])
            b.totals, b.shares = b.totals[used], b.shares.reshape(-1, CELLS)[used].ravel()
        b.close(stays)


Step = Words | Screen | Pairs


def asked(b: Block, block: int, step: Step | None, buckets: int) -> Iterator[tuple]:
    """The block's state, and for each bucket its keys in ascending order with what the block adds to them."""
    yield block, -1, int((b.flags & 1).sum()), b.data()
    if step is None:
        return
    b.lay()
    keys, values = step.ask(b)
    edges = bucket_edges(keys, buckets)
    for i in np.flatnonzero(np.diff(edges)).tolist():
        mine = slice(edges[i], edges[i + 1])
        yield block, i, 0, pack(keys[mine], *(v[mine].astype(k) for v, k in zip(values, step.asks, strict=True)))


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)


def read_texts(rows: DataFrame, buckets: int) -> DataFrame:
    """Blocks of texts with their first questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = (r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True))
        for i, held in enumerate(blocks(source, BLOCK_BYTES)):
            b, block = Block.of(held), (TaskContext.get().partitionId() << 32) + i
            yield to_batch([(block, -2, 0, b.texts()), *asked(b, block, Words(), buckets)])

    return rows.mapInArrow(run, ROWS_DDL)


def sums(asks: DataFrame, step: Step) -> DataFrame:
    """What each block is told by each bucket; ``facts``: different keys, keys met once and twice, and sums by class."""

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        parts = [unpack(d, np.uint64, *step.asks) for d in table["data"].to_pylist()]
        keys = np.concatenate([p[0] for p in parts])
        edges = np.cumsum([len(p[0]) for p in parts])[:-1]
        different, back = np.unique(keys, return_inverse=True)
        totals = [np.bincount(back, np.concatenate([p[1 + i] for p in parts]), len(different)) for i in range(len(step.asks))]
        told = [np.split(t[back].astype(k), edges) for t, k in zip(step.answer(totals), step.tells, strict=True)]
        cells = np.bincount(cell_of(different), totals[0], CELLS)
        facts = [int((totals[0] > 0).sum()), int((totals[0] == 1).sum()), int((totals[0] == 2).sum()), *(int(x) for x in cells)]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "open": pa.array([0] * len(parts), pa.int64()),
                         "data": pa.array([pack(*x) for x in zip(*told, strict=True)], pa.binary()), "facts": pa.array([facts, *[[0] * len(facts)] * (len(parts) - 1)], pa.list_(pa.int64()))})

    return asks.groupBy("bucket").applyInArrow(add, f"{ROWS_DDL}, facts array<long>")


def answer(texts: DataFrame, state: DataFrame, told: DataFrame, step: Step, after: Step | None, buckets: int) -> DataFrame:
    """The blocks with what they were told, and with their next questions."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.sort_by("bucket")
        data = rows["data"].to_pylist()
        b = Block(data[0], data[1])
        b.lay()
        step.ask(b)
        parts = [unpack(d, *step.tells) for d in data[2:]]
        step.tell(b, [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(step.tells)])
        return pa.Table.from_batches([to_batch(list(asked(b, rows["block"][0].as_py(), after, buckets)))])

    columns = ["block", "bucket", "open", "data"]
    return texts.select(columns).unionByName(state.select(columns)).unionByName(told.select(columns)).groupBy("block").applyInArrow(run, ROWS_DDL)


def score_documents(docs: DataFrame, train: str, least: int = LEAST, divergence: float = DIVERGENCE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row; ``train`` is an SQL condition on doc_id."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.expr(f"coalesce({train}, false)").alias("train"), text.alias("text"))
    paths: list[str] = []

    def keep(frame: DataFrame, label: str) -> DataFrame:
        paths.append(scratch_path(spark, label))
        frame = frame.withColumn("kind", F.least("bucket", F.lit(0)))  # -2: texts, -1: state, 0: asked or told
        frame.write.partitionBy("kind").parquet(paths[-1])
        return spark.read.schema(frame.schema).parquet(paths[-1])

    def part(path: str, kind: int) -> DataFrame:
        return spark.read.schema(f"{ROWS_DDL}, kind int").parquet(path).filter(F.col("kind") == kind)

    def ask_and_tell(step: Step) -> DataFrame:
        told = keep(sums(part(paths[-1], 0), step), "told")
        drop_path(spark, f"{paths[-2]}/kind=0")
        return told

    def advance(told: DataFrame, step: Step, after: Step | None) -> int:
        """Open tokens that are left."""
        state, answers = paths[-2:]
        now = keep(answer(part(paths[0], -2), part(state, -1), told, step, after, buckets), "state")
        for old in (f"{state}/kind=-1", answers):
            drop_path(spark, old)
        return now.agg(F.sum("open")).first()[0] or 0

    size = rows.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    buckets = max(1, math.ceil(size / BUCKET_BYTES))
    keep(read_texts(rows, buckets), "texts")
    told = ask_and_tell(Words())
    types, once, twice, *cells = (int(x or 0) for x in told.select(*(F.sum(F.col("facts")[i]) for i in range(3 + CELLS))).first())
    tokens, texts = totals(part(paths[0], -2))
    shares = [(c + 1) / (tokens + CELLS) for c in cells]
    facts = {"tokens": tokens, "texts": texts, "types": types, "discount": once / (once + 2 * twice) if once and twice else 0.5, "shares": shares}
    last = deepest(tokens, least)
    left = advance(told, Words(facts, least), Screen(1, least, divergence))
    for depth in range(1, last + 1):
        if not left:
            break
        screen, pairs = Screen(depth, least, divergence), Pairs(depth, least, depth == last)
        left = advance(ask_and_tell(screen), screen, pairs)
        left = advance(ask_and_tell(pairs), pairs, None if depth == last else Screen(depth + 1, least, divergence))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = Block(texts, data)
                b.lay()
                b.close(np.zeros(len(b.open), bool))
                yield pa.RecordBatch.from_arrays([pa.array(b.ids), pa.array(b.n.astype(np.int64) + 1), pa.array(b.known.astype(np.int64)), pa.array(b.base), pa.array(b.score)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    both = part(paths[0], -2).select("block", F.col("data").alias("texts")).join(part(paths[-1], -1).select("block", "data"), "block")
    found = both.select("texts", "data").mapInArrow(finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return found.select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def totals(texts: DataFrame) -> tuple[int, int]:
    """Training tokens and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                b = Block(data)
                use = b.train > 0
                yield pa.RecordBatch.from_arrays([pa.array([int(b.n[use].sum(dtype=np.int64) + use.sum())]), pa.array([int(use.sum())])], names=["tokens", "texts"])

    found = texts.select("data").mapInArrow(run, "tokens long, texts long").agg(F.sum("tokens"), F.sum("texts")).first()
    return int(found[0] or 0), int(found[1] or 0)

"""Removal of repeated word windows with a log-structured fingerprint index (operator 1).

The index is a set of immutable runs. A run holds, by bucket of the hash, the
sorted fingerprints of all windows of earlier batches. A new batch is cut into
windows; each task keeps the first of its equal windows and deals them to the
buckets. There the sorted new windows are merge-joined with the runs and with
each other: a window is a repeat if its hash is found and the independent second
hash, kept beside it, verifies it. New fingerprints make up the next run; when
there are as many runs as ``fan_in``, the merge writes one compacted run instead.
Documents then meet the positions of their repeats in hashed blocks.

A table is indexed in passes, each over all documents with its own share of the
buckets, so that the runs and what is dealt out hold a part of the windows at once.

A fingerprint has 52 bits to sort by and 32 bits to verify. A hot window
leaves each map task once, whatever the number of its copies.

Defined results: null and empty texts have no words; a document with fewer words
than a window keeps them all; windows are judged on the input and never cross
documents; a null doc_id counts as the smallest; rows that share a doc_id tie,
so that a window is a repeat only of one with a smaller doc_id or an earlier
start; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm.wordbuf import WordBuffer, blocks, window_hashes
from ticketloom.session import drop_path, scratch_path

WIDTH = 20
#: Bytes of text whose windows one bucket takes, and of documents that are rewritten together.
BUCKET_BYTES, BLOCK_BYTES = 5_000_000, 2_000_000
#: Bytes of text whose windows a task sorts at once.
SORT_BYTES = 4_000_000
#: Passes over a table, each with the windows of its share of the buckets, and the least number of buckets in one.
PASSES, PASS_BUCKETS = 3, 8
#: Fingerprints in one row of a run.
RUN_ROWS = 1 << 17
#: The upper 52 bits of a hash are kept, and 32 of the second hash.
HASH_BITS = np.uint64(0xFFFFFFFFFFFFF000)
NEW, REPEAT, RUN = 0, 1, 2
NULL_ID = -(1 << 63)

ROWS = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("keys", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32())), ("data", pa.binary())])
DDL = "bucket int, kind int, block long, docs array<long>, keys array<long>, counts array<int>, data binary"


def squeeze(*columns: np.ndarray) -> bytes:
    """Byte planes of equally long arrays, compressed; the first is sorted and stored by its differences."""
    planes = [np.array([len(columns[0])], np.int64).tobytes()]
    for i, x in enumerate(columns):
        if i == 0:
            x = np.diff(x, prepend=x.dtype.type(0))
        planes.append(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unsqueeze(data: bytes, *dtypes: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for i, kind in enumerate(dtypes):
        size = np.dtype(kind).itemsize
        x = np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).view(kind).ravel()
        out.append(np.cumsum(x, dtype=kind) if i == 0 else x)
        at += n * size
    return out


def text_key(text: bytes | None) -> int:
    """Tells rows with the same doc_id apart."""
    return xxhash.xxh32_intdigest(text or b"")


def block_column(n: int) -> Column:
    """The block of a document; those of one doc_id share it."""
    return F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))), F.lit(n))


def repeat_rows(ids: np.ndarray, keys: np.ndarray, at: np.ndarray, blocks_: np.ndarray) -> list[tuple]:
    """Rows that carry window starts to the blocks of their documents."""
    order = np.lexsort((at, keys, ids, blocks_))
    ids, keys, at, blocks_ = ids[order], keys[order], at[order], blocks_[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(ids)))
    out = []
    edges = np.flatnonzero(np.diff(blocks_[first], prepend=-1)) if len(first) else []
    for a, b in zip(edges, [*edges[1:], len(first)], strict=True):
        lo, hi = first[a], first[b] if b < len(first) else len(ids)
        out.append((int(blocks_[first[a]]), ids[first[a:b]], keys[first[a:b]], counts[a:b].astype(np.int32), at[lo:hi].astype(np.uint32).tobytes()))
    return out


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in ROWS]
    return pa.RecordBatch.from_arrays([pa.array([None if v is None else v for v in c], f.type) for c, f in zip(columns, ROWS, strict=True)], schema=ROWS)


class FingerprintIndex:
    """Runs of window fingerprints in the shared folder.

    ``expected_bytes`` sets the number of buckets, once for the life of the index. ``share`` (i, n): only the windows
    of the i-th of n ranges of buckets are indexed and found; equal windows are in one range.
    """

    def __init__(self, spark: SparkSession, expected_bytes: int, width: int = WIDTH, fan_in: int = 3, share: tuple[int, int] = (0, 1)) -> None:
        self.spark, self.width, self.fan_in = spark, width, fan_in
        self.buckets = max(1, math.ceil(expected_bytes / BUCKET_BYTES))
        self.blocks = max(1, math.ceil(expected_bytes / BLOCK_BYTES))
        self.low, self.high = (self.buckets * (share[0] + i) // share[1] for i in (0, 1))
        self.path = scratch_path(spark, "fingerprints")
        self.runs: list[str] = []
        self.batches = 0

    def add(self, docs: DataFrame, last: bool = False) -> DataFrame:
        """Index the batch; the starts of its repeated windows, packed by block of documents.

        Earlier batches count as earlier. With ``last`` no run is written for the batch.
        """
        width, buckets, low, high = self.width, self.buckets, self.low, self.high
        compact = not last and len(self.runs) + 1 >= self.fan_in

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((d, k, t) for b in batches for d, k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist(), strict=True))
            for held in blocks(rows, SORT_BYTES):
                held.sort(key=lambda r: r[0])
                buffer = WordBuffer([t for _, _, t in held])
                ids = np.array([d for d, _, _ in held], np.int64)
                keys = np.array([text_key(t) for _, _, t in held], np.int64)
                dealt = np.array([b for _, b, _ in held], np.int64)
                at = buffer.windows(width)
                if not len(at):
                    continue
                h = window_hashes(buffer.word_hashes(0), at, width, 0) & HASH_BITS
                if high - low < buckets:
                    bucket = (h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
                    inside = (bucket >= np.uint64(low)) & (bucket < np.uint64(high))
                    h, at = h[inside], at[inside]
                    if not len(at):
                        continue
                check = (window_hashes(buffer.word_hashes(1), at, width, 1) >> np.uint64(32)).astype(np.uint32)
                doc = np.searchsorted(buffer.first, at, "right") - 1
                order = np.argsort(h, kind="stable")
                h, check, doc, at = h[order], check[order], doc[order], at[order]
                same = (h[1:] == h[:-1]) & (check[1:] == check[:-1])
                if ((h[1:] == h[:-1]) & ~same).any():
                    order = np.lexsort((at, check, h))
                    h, check, doc, at = h[order], check[order], doc[order], at[order]
                    same = (h[1:] == h[:-1]) & (check[1:] == check[:-1])
                start = (at - buffer.first[doc]).astype(np.uint32)
                repeat = np.concatenate([[False], same])
                first = np.maximum.accumulate(np.where(repeat, 0, np.arange(len(h))))
                tied = repeat & (ids[doc] == ids[doc[first]]) & (start <= start[first])
                lost = repeat & ~tied
                out = []
                if lost.any():
                    found = doc[lost]
                    for block, a, b, c, data in repeat_rows(ids[found], keys[found], start[lost], dealt[found]):
                        out.append((block % buckets, REPEAT, block, a, b, c, data))
                h, check, doc, start = h[~lost], check[~lost], doc[~lost], start[~lost]
                bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # ascending, as h is
                edges = np.searchsorted(bucket, np.arange(low, high + 1))
                for b in range(low, high):
                    lo, hi = edges[b - low], edges[b - low + 1]
                    if lo < hi:
                        used, local = np.unique(doc[lo:hi], return_inverse=True)
                        table = squeeze(ids[used], keys[used].astype(np.uint32), dealt[used].astype(np.uint32))
                        out.append((b, NEW, None, None, None, None, len(table).to_bytes(8, "little") + table + squeeze(h[lo:hi], check[lo:hi], local.astype(np.uint32), start[lo:hi])))
                yield to_batch(out)

        def merge(table: pa.Table) -> pa.Table:
            out: list[tuple] = []
            h, check, ids, keys, dealt, start = ([] for _ in range(6))
            old_h, old_check = [], []
            bucket = table["bucket"][0].as_py()
            for row in table.to_pylist():
                if row["kind"] == REPEAT:
                    out.append((row["bucket"], REPEAT, row["block"], row["docs"], row["keys"], row["counts"], row["data"]))
                elif row["kind"] == RUN:
                    a, b = unsqueeze(row["data"], np.uint64, np.uint32)
                    old_h.append(a)
                    old_check.append(b)
                else:
                    data = row["data"]
                    cut_at = 8 + int.from_bytes(data[:8], "little")
                    docs_, keys_, dealt_ = unsqueeze(data[8:cut_at], np.int64, np.uint32, np.uint32)
                    a, b, local, at = unsqueeze(data[cut_at:], np.uint64, np.uint32, np.uint32, np.uint32)
                    h.append(a)
                    check.append(b)
                    ids.append(docs_[local])
                    keys.append(keys_[local].astype(np.int64))
                    dealt.append(dealt_[local].astype(np.int64))
                    start.append(at)
            n_old = sum(map(len, old_h))
            if not h and not (compact and n_old):
                return pa.Table.from_batches([to_batch(out)])
            h, check = np.concatenate([*old_h, *h]), np.concatenate([*old_check, *check])
            order = np.argsort(h, kind="stable")  # runs come first among equals
            sorted_h = h[order]
            twin = np.zeros(len(h), bool)
            equal = sorted_h[1:] == sorted_h[:-1]
            twin[1:] |= equal
            twin[:-1] |= equal
            keep = np.ones(len(h), bool)  # of all entries, by place in h: those that stay in the index
            if twin.any() and ids:
                ids, keys, dealt, start = (np.concatenate(x) for x in (ids, keys, dealt, start))
                some = order[twin]
                new = some >= n_old
                place = np.where(new, some - n_old, 0)
                doc, at = np.where(new, ids[place], NULL_ID), np.where(new, start[place].astype(np.int64), -1)
                by = np.lexsort((at, doc, new, check[some], h[some]))
                some, new, place, doc, at = some[by], new[by], place[by], doc[by], at[by]
                same = np.concatenate([[False], (h[some[1:]] == h[some[:-1]]) & (check[some[1:]] == check[some[:-1]])])
                first = np.maximum.accumulate(np.where(same, 0, np.arange(len(some))))
                keep[some[same]] = False
                lost = same & new & (~new[first] | (doc != doc[first]) | (at != at[first]))
                if lost.any():
                    p = place[lost]
                    for block, a, b, c, data in repeat_rows(ids[p], keys[p], start[p], dealt[p].astype(np.int64)):
                        out.append((bucket, REPEAT, block, a, b, c, data))
            if not last:
                stays = order[keep[order]]
                if not compact:
                    stays = stays[stays >= n_old]
                for i in range(0, len(stays), RUN_ROWS):
                    part = stays[i : i + RUN_ROWS]
                    out.append((bucket, RUN, None, None, None, None, squeeze(h[part], check[part])))
            return pa.Table.from_batches([to_batch(out)])

        target = f"{self.path}/batch-{self.batches}"
        self.batches += 1
        self._write(docs, cut, merge, target)
        if compact:
            self._forget()
        if not last:
            self.runs.append(f"{target}/part=run")
        return self.spark.read.schema(DDL + ", part string").parquet(target).filter("part = 'repeat'").drop("part")

    def _write(self, docs: DataFrame, cut: Callable, merge: Callable, target: str) -> None:
        source = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), block_column(self.blocks).alias("block"), F.col("text").cast("string").alias("text"))
        rows = source.mapInArrow(cut, DDL)
        for run in self.runs:
            rows = rows.unionByName(self.spark.read.schema(DDL).parquet(run).withColumn("kind", F.lit(RUN)))
        merged = rows.groupBy("bucket").applyInArrow(merge, DDL)
        merged.withColumn("part", F.when(F.col("kind") == RUN, "run").otherwise("repeat")).write.partitionBy("part").parquet(target)

    def _forget(self) -> None:
        for run in self.runs:
            drop_path(self.spark, run)
        self.runs = []

    def close(self) -> None:
        """Delete the runs; the repeats that add() returned stay readable."""
        self._forget()


def rewrite(docs: DataFrame, repeats: DataFrame, n_blocks: int, width: int = WIDTH) -> DataFrame:
    """Documents with their words, without those in repeated windows, joined by spaces.

    All columns of ``docs`` stay (``text`` rewritten, null texts stay null), with loom_n_words, loom_n_removed and loom_sha256.
    """
    docs = docs.drop("loom_n_words", "loom_n_removed", "loom_sha256")
    schema = docs.withColumn("text", F.col("text").cast("string")).schema.add("loom_n_words", "long").add("loom_n_removed", "long").add("loom_sha256", "string")

    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        lost: dict[tuple[int, int], list[np.ndarray]] = {}
        for row in found.to_pylist():
            at, i = np.frombuffer(row["data"], np.uint32), 0
            for doc, key, n in zip(row["docs"], row["keys"], row["counts"], strict=True):
                lost.setdefault((doc, key), []).append(at[i : i + n])
                i += n
        texts, counts, removed, digests = [], [], [], []
        for doc, text in zip(table[id_at].to_pylist(), table[text_at].cast(pa.binary()).to_pylist(), strict=True):
            words = (text or b"").split()
            starts = lost.get((NULL_ID if doc is None else doc, text_key(text)))
            n = len(words)
            if starts:
                cover = np.zeros(n + 1, np.int64)
                for at in starts:
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + np.uint32(width), -1)
                words = list(compress(words, (np.cumsum(cover[:n]) == 0).tolist()))
            kept = b" ".join(words)
            texts.append(None if text is None else kept.decode())
            counts.append(n)
            removed.append(n - len(words))
            digests.append(hashlib.sha256(kept).hexdigest())
        columns = [pa.array(texts, pa.string()) if name == "text" else table[f"c{i}"] for i, name in enumerate(docs_columns)]
        return pa.table([*columns, pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())], names=[f.name for f in schema])

    docs_columns = docs.columns
    # columns go by place: names of the documents may be any
    left = docs.select(block_column(n_blocks).alias("loom_block"), *(docs[c].cast("string") if c == "text" else docs[c] for c in docs_columns)).toDF("loom_block", *(f"c{i}" for i in range(len(docs_columns))))
    id_at, text_at = (f"c{docs_columns.index(c)}" for c in ("doc_id", "text"))
    right = repeats.filter(F.col("block").isNotNull()).select(F.col("block").alias("loom_block"), "docs", "keys", "counts", "data")
    return left.groupBy("loom_block").cogroup(right.groupBy("loom_block")).applyInArrow(run, schema)


def remove_repeats(docs: DataFrame, batches: int = 4, width: int = WIDTH, fan_in: int = 3) -> DataFrame:
    """Remove every word in a window that also starts earlier; the table is indexed in ``batches`` by doc_id, in each of up to ``PASSES`` passes."""
    spark = docs.sparkSession
    facts = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("size"), F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10000).alias("at")).first()
    size = facts["size"] or 0
    passes = max(1, min(PASSES, math.ceil(size / BUCKET_BYTES) // PASS_BUCKETS))
    edges = sorted({*(facts["at"] or [])})
    parts = []
    for k in range(passes):
        index = FingerprintIndex(spark, size, width, fan_in, (k, passes))
        for i in range(len(edges) + 1):
            low = F.lit(True) if i == 0 else F.col("doc_id") > edges[i - 1]
            high = F.lit(True) if i == len(edges) else (F.col("doc_id") <= edges[i])
            inside = (low & high) if i else (high | F.col("doc_id").isNull())
            parts.append(index.add(docs.filter(inside), last=i == len(edges)))
        index.close()
    repeats = parts[0]
    for part in parts[1:]:
        repeats = repeats.unionByName(part)
    return rewrite(docs, repeats, index.blocks, width)

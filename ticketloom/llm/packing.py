"""Packing token ids into windows by Karmarkar-Karp differencing (operator 8).

Each document's ids, with an end id, are cut into pieces of at most one window.
A piece that fills a window is a sequence by itself. The rest are dealt by a
hash into groups of a bounded number of windows; within a group, partial
partitions into ``k`` windows are merged largest imbalance first, the fullest
window of one with the emptiest of the other, until one partition is left. If
one of its windows is over the capacity, the group is partitioned anew into more
windows. A group needs lengths only, so no ids are shuffled.

Defined results: a null or empty text has the end id alone; every row is packed,
also rows with equal doc_id (their pieces tie and are told apart by their order
in the group); an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import bisect
import heapq
import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.llm import bpe
from ticketloom.session import materialise

WINDOW = 4096
#: A rest longer than this is cut in equal parts no longer than this, so that windows hold several pieces.
PART = 1024
#: Windows of one group; its pieces are packed in one task.
GROUP_WINDOWS = 256

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, window: int = WINDOW, part: int = PART) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: whole windows, then the rest in near-equal parts."""
    full = [(i, window) for i in range(0, n - n % window, window)]
    rest, at = n % window, n - n % window
    k = max(1, math.ceil(rest / part))
    for j in range(k if rest else 0):
        size = rest // k + (j < rest % k)
        full.append((at, size))
        at += size
    return full


def difference(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window (0 to k-1) of each piece, by Karmarkar-Karp differencing into ``k`` windows.

    A partial partition keeps its windows that hold pieces, by their sums; the others are empty. Where two of them fit
    side by side no windows meet, and their lists are merged; else windows are added in arrays.
    """
    n = len(sizes)
    above = [-1] * n  # of each bundle of pieces: the bundle that took it up
    heap = [(-size, i, [size], [i]) for i, size in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, who_a = heapq.heappop(heap)
        _, _, b, who_b = heapq.heappop(heap)
        if len(a) + len(b) <= k:
            if len(b) == 1:
                at = bisect.bisect_left(a, b[0])
                a.insert(at, b[0])
                who_a.insert(at, who_b[0])
                sums, who = a, who_a
            else:
                both = sorted(zip(b[::-1] + a, who_b[::-1] + who_a, strict=True), key=itemgetter(0))
                sums, who = [x for x, _ in both], [x for _, x in both]
            if len(sums) == k and sums[0]:
                sums = [x - sums[0] for x in sums]
        else:
            x, y = np.zeros(k, np.int64), np.zeros(k, np.int64)
            in_a, in_b = np.full(k, -1, np.int64), np.full(k, -1, np.int64)
            x[k - len(a) :], in_a[k - len(a) :] = a, who_a
            y[: len(b)], in_b[: len(b)] = b[::-1], who_b[::-1]
            both = (in_a >= 0) & (in_b >= 0)
            held = np.where(in_a >= 0, in_a, in_b)
            made = len(above)
            new = np.arange(made, made + int(both.sum()))
            above += [-1] * len(new)
            for i, j, m in zip(in_a[both].tolist(), in_b[both].tolist(), new.tolist(), strict=True):
                above[i] = above[j] = m
            held[both] = new
            total = x + y
            at = np.argsort(total, kind="stable")
            total, held = total[at], held[at]
            total = total - total[0]
            some = held >= 0
            sums, who = total[some].tolist(), held[some].tolist()
        heapq.heappush(heap, (-sums[-1], order, sums, who))
        order += 1
    where = [-1] * len(above)
    _, _, _, who = heap[0]
    for i, x in enumerate(who, k - len(who)):
        where[x] = i
    for i in range(len(above) - 1, -1, -1):
        if above[i] >= 0:
            where[i] = where[above[i]]
    return np.array(where[:n], np.int64)


def pack_group(sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The window of each piece; the number of windows rises until none is over the capacity."""
    total = int(sizes.sum())
    k = max(1, -(-total // window))
    while True:
        where = difference(sizes, k)
        most = int(np.bincount(where, sizes, minlength=k).max())
        if most <= window:
            return where
        k += max(1, math.ceil(k * (most - window) / window / 2))


def document_pieces(docs: DataFrame, path: str | None = None, end_id: int = 2, keep: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece; without ``keep`` workers give their caches back after each task."""
    spark: SparkSession = docs.sparkSession
    spec = spark.sparkContext.broadcast(bpe.read_spec(path or bpe.default_tokenizer()))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = bpe.tokenizer(spec.value)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            ids_of = tokens.encode_all(x.as_py() for x in batch.column(1).cast(pa.binary()))
            for doc_id, parts in zip(batch.column(0).to_pylist(), ids_of, strict=True):
                ids = memoryview(b"".join([*parts, end]))
                n = len(ids) // 4
                for start, length in cuts(n):
                    for column, value in zip(rows, (doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        if not keep:
            tokens.forget()

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, PIECE)


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 2, keep: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = materialise(document_pieces(docs, path, end_id, keep), "pieces")
    total = pieces.filter(F.col("length") < WINDOW).agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(total / (WINDOW * GROUP_WINDOWS)))
    # the documents of a group are packed together; whole windows are their own sequences
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "length", "ids_crc32"), F.lit(groups)))
    schema = PIECE + ", group long, sequence_id long, offset long"

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "start", "ids_crc32"], kind="stable", na_position="first").reset_index(drop=True)
        where = pack_group(rows["length"].to_numpy(np.int64))
        rows["sequence_id"] = (int(key[0]) << 32) + where
        rows["offset"] = rows.groupby("sequence_id")["length"].cumsum() - rows["length"]
        return rows

    rest = dealt.filter(F.col("length") < WINDOW).groupBy("group").applyInPandas(run, schema).drop("group")
    # their number in the written table, above all ids of groups
    full = pieces.filter(F.col("length") == WINDOW).select("*", (F.monotonically_increasing_id() + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return rest.unionByName(full)

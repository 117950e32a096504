"""Document fingerprints as invertible Bloom lookup sketches (operator 9).

A text is a set of paragraph digests: its lines, long ones cut after words whose
hash says so, with the occurrence number of equal ones. A sketch adds each digest
to three of its cells (count, XOR of digests, XOR of check values). The sketch of
one version less that of another holds what they differ in; cells with one digest
left are peeled until none is, which recovers the differing digests. If cells
remain, both versions are sketched anew, ``GROWTH`` times as large. Likeness is twice
the common digests among the digests of both.

The sketches of all texts of a batch are built, subtracted and peeled together.

Defined results: a null text is the empty text; texts without words have no
digests, and two of them have likeness 1; rows are ordered by descending doc_id,
null last, ties by text, and after the last comes the first, so that a single row
is its own next; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.llm.wordbuf import WordBuffer, mix
from ticketloom.session import materialise

#: Cells of a fingerprint and of the first sketches that are subtracted; their growth on failure.
CELLS, FIRST, GROWTH = 9, 48, 4
#: Long lines are cut after one word in so many.
CUT = 8
#: Bytes of text of one range of documents, and of documents that are sketched at once.
RANGE_BYTES, BATCH_BYTES = 8_000_000, 2_000_000
U64 = np.uint64


def digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The paragraph digests of all texts, and where those of each text begin (one more at the end)."""
    buffer = WordBuffer(texts)
    n = len(buffer.starts)
    if not n:
        return np.zeros(0, U64), np.zeros(len(texts) + 1, np.int64)
    h = buffer.word_hashes(0)
    line = np.cumsum(buffer.bytes == 10, dtype=np.int64)[buffer.starts]
    last = np.ones(n, bool)
    last[:-1] = (line[1:] != line[:-1]) | (h[:-1] % U64(CUT) == 0)
    begin = np.flatnonzero(np.concatenate([[True], last[:-1]]))
    place = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    unit = mix(np.add.reduceat(mix(h + place.astype(U64) * U64(0x9E3779B97F4A7C15)), begin))
    text = np.searchsorted(buffer.first, begin, "right") - 1
    order = np.lexsort((unit, text))
    unit, text = unit[order], text[order]
    new = np.concatenate([[True], (unit[1:] != unit[:-1]) | (text[1:] != text[:-1])])
    start = np.flatnonzero(new)
    again = np.arange(len(unit)) - np.repeat(start, np.diff(np.append(start, len(unit))))
    return mix(unit + again.astype(U64) * U64(0xD6E8FEB86659FD93)), np.searchsorted(text, np.arange(len(texts) + 1))


def places(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """The three cells of each digest, one in each third of the sketch."""
    third = cells // 3
    return [(mix(keys ^ U64(j + 1)) % U64(third)).astype(np.int64) + j * third for j in range(3)]


class Sketches:
    """Sketches of the same size of several texts."""

    def __init__(self, keys: np.ndarray, owner: np.ndarray, n: int, cells: int) -> None:
        self.cells = cells
        self.count = np.zeros(n * cells, np.int64)
        self.key = np.zeros(n * cells, U64)
        self.check = np.zeros(n * cells, U64)
        check = mix(keys)
        for at in places(keys, cells):
            at = owner * cells + at
            np.add.at(self.count, at, 1)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def less(self, a: np.ndarray, b: np.ndarray) -> Sketches:
        """The sketches ``a`` less the sketches ``b``, pair by pair."""
        out = Sketches.__new__(Sketches)
        out.cells = self.cells
        grid = lambda x: x.reshape(-1, self.cells)
        out.count = (grid(self.count)[a] - grid(self.count)[b]).ravel()
        out.key = (grid(self.key)[a] ^ grid(self.key)[b]).ravel()
        out.check = (grid(self.check)[a] ^ grid(self.check)[b]).ravel()
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which sketches were recovered in full; of the digests found their sketch, the digest and its sign."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[mix(self.key[pure]) == self.check[pure]]
            if not len(pure):
                break
            owner, key, sign = pure // self.cells, self.key[pure], self.count[pure]
            _, one = np.unique(np.stack([owner.astype(U64), key]), axis=1, return_index=True)
            owner, key, sign = owner[one], key[one], sign[one]
            found.append((owner, key, sign))
            check = mix(key)
            for at in places(key, self.cells):
                at = owner * self.cells + at
                np.subtract.at(self.count, at, sign)
                np.bitwise_xor.at(self.key, at, key)
                np.bitwise_xor.at(self.check, at, check)
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        owner, key, sign = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64))
        return ~left.reshape(-1, self.cells).any(axis=1), owner, key, sign


def differences(keys: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of texts, digests that only the one and only the other has, recovered from sketches."""
    out = np.zeros((len(a), 2), np.int64)
    todo, cells = np.arange(len(a)), FIRST
    sizes = np.diff(first)
    while len(todo):
        used, local = np.unique(np.concatenate([a[todo], b[todo]]), return_inverse=True)
        owner = np.repeat(np.arange(len(used)), sizes[used])
        mine = np.repeat(first[used] - np.concatenate([[0], np.cumsum(sizes[used])[:-1]]), sizes[used]) + np.arange(len(owner))
        sketches = Sketches(keys[mine], owner, len(used), cells)
        done, pair, _, sign = sketches.less(local[: len(todo)], local[len(todo) :]).peel()
        for side, value in ((0, 1), (1, -1)):
            out[todo[done], side] = np.bincount(pair[sign == value], minlength=len(todo))[done]
        todo, cells = todo[~done], cells * GROWTH
    return out


def likeness(keys: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    sizes = np.diff(first)
    only = differences(keys, first, a, b)
    both = sizes[a] + sizes[b]
    return np.where(both > 0, 2 * (sizes[a] - only[:, 0]) / np.maximum(both, 1), 1.0)


def fingerprint_texts(keys: np.ndarray, first: np.ndarray) -> list[str]:
    """The number of digests and the cells of a sketch of ``CELLS``, of each text."""
    n = len(first) - 1
    sizes = np.diff(first)
    s = Sketches(keys, np.repeat(np.arange(n), sizes), n, CELLS)
    cells = np.stack([s.key, s.check]).T.reshape(n, -1)
    counts = s.count.astype(np.int32).reshape(n, -1)
    return [f"{size}:" + base64.b64encode(cells[i].tobytes() + counts[i].tobytes()).decode() for i, size in enumerate(sizes.tolist())]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
NAMES = [x.split()[0] for x in OUT.split(", ")]


def compare(rows: list[tuple[int | None, str, str]]) -> pa.Table:
    """Result rows of (doc_id, text, text of the next document)."""
    texts: list[bytes] = []
    known: dict[str, int] = {}
    place = []
    edited_sha = []
    for _, text, after in rows:
        n = len(text) // 3
        edited = (text[: len(text) - n] + after[:n]) if n else text
        raw = edited.encode()
        edited_sha.append(hashlib.sha256(raw).hexdigest())
        spots = []
        for x in (text, after):
            if x not in known:
                known[x] = len(texts)
                texts.append(x.encode())
            spots.append(known[x])
        place.append((*spots, len(texts)))
        texts.append(raw)
    keys, first = digests(texts)
    a, b, e = (np.array(x, np.int64) for x in zip(*place, strict=True))
    prints = fingerprint_texts(keys, first)
    near = likeness(keys, first, np.concatenate([a, a]), np.concatenate([e, b]))
    return pa.table([pa.array([d for d, _, _ in rows], pa.int64()), pa.array([len(t) for _, t, _ in rows], pa.int64()), pa.array(edited_sha), pa.array([prints[i] for i in a]), pa.array([prints[i] for i in e]), pa.array(near[: len(rows)]), pa.array(near[len(rows) :])], names=NAMES)


def batched(rows: Iterator[tuple[int | None, str, str]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 2 * len(row[1])
        if size >= BATCH_BYTES:
            yield from compare(held).to_batches()
            held, size = [], 0
    if held:
        yield from compare(held).to_batches()


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint, that of its edited version, and its likeness to that and to the next document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / RANGE_BYTES))
    # ranges of doc_id alone: the bounds are sampled on the driver, and texts must not be among them
    ranged = rows.repartitionByRange(n, F.desc_nulls_last("doc_id")).sortWithinPartitions(F.desc_nulls_last("doc_id"), F.asc("text"))
    schema = OUT + ", part int, head string, tail string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ends: list[tuple[int | None, str]] = []  # the first and the last row

        def pairs() -> Iterator[tuple[int | None, str, str]]:
            before = None
            for batch in batches:
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    if before is None:
                        ends.append((doc, text))
                    else:
                        yield (*before, text)
                    before = (doc, text)
            if before is not None:
                ends.append(before)

        for batch in batched(pairs()):
            nothing = pa.nulls(batch.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), nothing, nothing], names=[*NAMES, "part", "head", "tail"])
        if ends:
            blank = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array([ends[1][0]], pa.int64()), *blank, pa.array([part], pa.int32()), pa.array([ends[0][1]]), pa.array([ends[1][1]])], names=[*NAMES, "part", "head", "tail"])

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batched(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))

    found = materialise(ranged.mapInArrow(run, schema), "versions")
    # the last row of a range is followed by the first of the next range that has any: one row for each range
    ends = found.filter("tail is not null")
    numbers = ends.select("part")
    nexts = numbers.withColumn("to", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    heads = ends.select(F.col("part").alias("to"), F.col("head").alias("after"))
    seams = ends.select("part", "doc_id", "tail").join(nexts, "part").join(heads, "to").select("doc_id", "tail", "after").mapInArrow(stitch, OUT)
    return found.filter("tail is null").select(*NAMES).unionByName(seams)

"""Knowledge base: documents, sections, near-duplicate collapse, fingerprints."""

from __future__ import annotations

import difflib
import heapq
import os
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions.text import strip

#: Sections below so many estimated tokens join the one before; ratio from which two bodies are near-duplicates;
#: sentences of its own that save one; characters from which a sentence counts.
SMALL, RATIO, OWN, SENTENCE = 40, 0.7, 2, 25
#: Characters from which a text is bounded by its rare characters (200 at least, where the matcher begins to skip common ones);
#: buckets of characters and of substrings of four; bits of the table of substrings; for the rounding of sums.
LONG, CHARS, FOURS, SLOTS, SLACK = 400, 256, 1024, 20, 0.9999
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_WORDS, _ENDS, _SPACE = regex.compile(r"\W+"), regex.compile(r"(?<=[.!?])\s+|\n"), regex.compile(r"\s+")


def sections(pages: DataFrame) -> DataFrame:
    """doc_id, n, heading, body of the parts of a text between markdown-like or HTML headings (``page_id``, ``html``)."""
    marked = F.regexp_replace("html", r"(?is)<h([1-6])[^>]*>(.*?)</h\1>", "\u001e$2\u001f")
    plain = F.regexp_replace(F.regexp_replace(marked, r"(?i)<(?:br|/p|/div|/li|/tr)[^>]*>", "\n"), r"<[^>]+>", "")
    parts = pages.select(F.col("page_id").alias("doc_id"), F.posexplode(F.split(plain, "\u001e")).alias("n", "part"))
    split = F.split("part", "\u001f")
    body = strip(F.when(F.size(split) > 1, F.get(split, F.lit(1))).otherwise(F.col("part")))
    return parts.select("doc_id", "n", strip(F.when(F.size(split) > 1, F.get(split, F.lit(0))).otherwise("")).alias("heading"), body.alias("body")).filter("body <> '' OR heading <> ''")


def merge_small(rows: DataFrame, small: int = SMALL) -> DataFrame:
    """Sections that are too small join the kept section before them; the first is always kept."""
    order = Window.partitionBy("doc_id").orderBy("n")
    size = F.bround(F.length("body") / 4, 0)
    keeps = ((size >= small) | (F.row_number().over(order) == 1)).cast("int")
    grouped = rows.withColumn("keeps", keeps).withColumn("g", F.sum("keeps").over(order))
    first = F.min_by("heading", "n")
    texts = F.array_sort(F.collect_list(F.struct("n", "keeps", "heading", "body")))
    joined = F.array_join(F.transform(texts, lambda x: F.when(x["keeps"] == 1, x["body"]).otherwise(F.concat(F.when(x["heading"] != "", F.concat(F.lit("\n"), x["heading"], F.lit("\n"))).otherwise(F.lit("")), x["body"]))), "\n")
    return grouped.groupBy("doc_id", "g").agg(F.min("n").alias("n"), first.alias("heading"), joined.alias("body")).drop("g")


def is_navigation(body: Column, headings: Column) -> Column:
    """Whether at least six in ten of the lines that are not blank stand in some heading; no lines counts as such."""
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.lower(F.regexp_replace(x, r"^[\s.]+|[\s.]+$", ""))), lambda x: x != "")
    inside = F.filter(lines, lambda x: F.exists(headings, lambda h: F.contains(F.lower(h), F.regexp_replace(x, r"^[0-9. ]+", ""))))
    return F.when(F.size(lines) == 0, True).otherwise(F.size(inside) >= 0.6 * F.size(lines))


def flat(text: str) -> str:
    return _WORDS.sub(" ", text.lower()).strip()


def sentences(text: str) -> list[str]:
    return [_SPACE.sub(" ", x).strip() for x in _ENDS.split(text) if len(x.strip()) > SENTENCE]


def similar(mine: str, other: str) -> bool:
    """Whether the matcher's ratio is at least RATIO: its blocks are found largest stretch first, until that is decided."""
    if mine == other:
        return True
    total = len(mine) + len(other)
    matcher = difflib.SequenceMatcher(None, mine, other)
    found, left = 0, min(len(mine), len(other))
    open_parts = [(-left, 0, len(mine), 0, len(other))]
    while open_parts and 2.0 * found / total < RATIO <= 2.0 * (found + left) / total:
        most, alo, ahi, blo, bhi = heapq.heappop(open_parts)
        left += most
        i, j, n = matcher.find_longest_match(alo, ahi, blo, bhi)
        if n:
            found += n
            for part in ((alo, i, blo, j), (i + n, ahi, j + n, bhi)):
                most = min(part[1] - part[0], part[3] - part[2])
                if most:
                    left += most
                    heapq.heappush(open_parts, (-most, *part))
    return 2.0 * found / total >= RATIO


class _Features:
    """What bounds the matcher's ratio of a text against others, without running it.

    From 200 characters on, the matcher starts a block only at a character that makes up about 1 % of ``other`` at most
    (a rare one); one block at most has none, which begins both texts. So blocks are disjoint, hold a rare character
    each, and cannot be more than the rare characters in common.
    """

    def __init__(self, text: str) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        self.grams = [codes]  # hashes of the substrings of 1, 2, 4, 8 and 16 characters
        for step in (1, 2, 4, 8):
            x = self.grams[-1]
            x = (x[: max(0, len(x) - step)] * _MIX[0] + x[step:]) * _MIX[1]
            self.grams.append(x ^ (x >> np.uint64(31)))
        chars = np.bincount((codes & np.uint64(CHARS - 1)).astype(np.int64), minlength=CHARS)
        fours = np.bincount((self.grams[2] >> np.uint64(64 - FOURS.bit_length() + 1)).astype(np.int64), minlength=FOURS)
        self.counts = np.concatenate([3 * chars, fours]).astype(np.float32)
        self._codes = codes

    def slots(self, n: int) -> np.ndarray:
        return (self.grams[n] >> np.uint64(64 - SLOTS)).astype(np.int32)

    def marks(self) -> np.ndarray:
        return np.concatenate([self.slots(n) for n in (2, 3, 4)])

    def as_other(self, text: str) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """Counts with rare characters alone, the place of the first one, and for each side of each: a substring that
        a block holds if it reaches further than the last one said, and by how many characters it may then be longer."""
        size = len(text)
        rare = [ord(c) for c, n in Counter(text).items() if n <= size // 100 + 1]
        at = np.flatnonzero(np.isin(self._codes, np.array(rare, np.uint64)))
        chars = np.bincount((self._codes[at] & np.uint64(CHARS - 1)).astype(np.int64), minlength=CHARS)
        counts = np.concatenate([3 * chars, self.counts[CHARS:]]).astype(np.float32)
        after, before = np.diff(np.append(at, size)), np.diff(np.append(-1, at)) - 1
        slots, gains = [], []
        for n, reach, most in ((2, 4, 8), (3, 8, 16), (4, 16, size)):  # a block that holds `reach` characters from here on
            of = self.slots(n)
            gain = np.minimum(after, most - 1 if most < size else size) - (reach - 1)
            slots.append(of[at[gain > 0]])
            gains.append(gain[gain > 0])
            gain = np.minimum(before, most - 2 if most < size else size) - (reach - 2)
            slots.append(of[at[gain > 0] - reach + 1])
            gains.append(gain[gain > 0])
        return counts, int(at[0]) if len(at) else size, np.concatenate(slots), np.concatenate(gains)


class _Lanes:
    """Up to 64 texts side by side in long integers: their longest common subsequences with a text, all at once."""

    def __init__(self) -> None:
        self.places, self.starts, self.sizes = [], [], []
        self.bits, self.ones, self.masks = 0, 0, {}

    def add(self, place: int, text: str) -> None:
        self.places.append(place)
        self.starts.append(self.bits)
        self.sizes.append(len(text))
        own: dict[str, int] = {}
        for i, c in enumerate(text):
            own[c] = own.get(c, 0) | 1 << i
        for c, mask in own.items():
            self.masks[c] = self.masks.get(c, 0) | mask << self.bits
        self.ones |= ((1 << len(text)) - 1) << self.bits
        self.bits += len(text) + 1  # the bit between takes the carry

    def near(self, text: str) -> list[int]:
        """The places of the texts whose ratio may reach RATIO: a matching is a common subsequence."""
        sizes = np.array(self.sizes)
        total = sizes + len(text)
        if not (2.0 * np.minimum(sizes, len(text)) >= RATIO * total * SLACK).any():
            return []
        row, ones = self.ones, self.ones
        for mask in map(self.masks.get, text):
            if mask is not None:
                both = row & mask
                row = ((row + both) | (row ^ both)) & ones
        left = np.unpackbits(np.frombuffer(row.to_bytes(self.bits // 8 + 1, "little"), np.uint8), bitorder="little")
        common = sizes - np.add.reduceat(left, self.starts, dtype=np.int64)
        fits = np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0) >= RATIO
        return [self.places[i] for i in np.flatnonzero(fits)]


class Kept:
    """Kept texts in order, and the first of them that is similar to a text: exact bounds spare most comparisons."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.bodies: list[str] = []
        self.pools: dict[int, str] = {}
        self.lanes: list[_Lanes] = []
        self.long: list[int] = []
        self.others: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.counts, self.sizes = np.zeros((64, CHARS + FOURS), np.float32), np.zeros(64, np.int64)
        self.marked = np.zeros(1 << SLOTS, bool)
        self.last: tuple[str, _Features] | None = None

    def features(self, text: str) -> _Features:
        if self.last is None or self.last[0] != text:
            self.last = text, _Features(text)
        return self.last[1]

    def add(self, text: str, body: str) -> None:
        place = len(self.texts)
        self.texts.append(text)
        self.bodies.append(body)
        if len(text) < LONG:
            if not self.lanes or len(self.lanes[-1].places) == 64:
                self.lanes.append(_Lanes())
            self.lanes[-1].add(place, text)
            return
        n = len(self.long)
        if n == len(self.sizes):
            self.counts, self.sizes = np.concatenate([self.counts, np.zeros_like(self.counts)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.counts[n], *other = self.features(text).as_other(text)
        self.others.append(tuple(other))
        self.sizes[n] = len(text)
        self.long.append(place)

    def pool(self, place: int) -> str:
        if place not in self.pools:
            self.pools[place] = " ".join(sentences(self.bodies[place])).lower()
        return self.pools[place]

    def first(self, text: str, start: int = 0) -> int | None:
        """The place, from ``start`` on, of the first kept text of a ratio of at least RATIO."""
        found = self._first_short(text, start)
        return self._first_long(text, start, len(self.texts) if found is None else found, found)

    def _first_short(self, text: str, start: int) -> int | None:
        if RATIO * (len(text) + 0.0) > 2.0 * LONG:
            return None
        for lanes in self.lanes:
            if lanes.places[-1] >= start:
                for place in lanes.near(text):
                    if place >= start and similar(text, self.texts[place]):
                        return place
        return None

    def _first_long(self, text: str, start: int, end: int, found: int | None) -> int | None:
        low, high = bisect_left(self.long, start), bisect_left(self.long, end)
        size, marks = len(text), None
        for at in range(low, high, 128):
            sizes = self.sizes[at : min(at + 128, high)]
            rows = at + np.flatnonzero(2.0 * np.minimum(sizes, size) >= RATIO * (sizes + size) * SLACK)
            if not len(rows):
                continue
            mine = self.features(text)
            # of a block of n characters, n - 3 substrings of four are common; it holds a rare character or begins the texts
            most = np.minimum(self.counts[rows], mine.counts).sum(axis=1) + 3
            for i in rows[2.0 * most >= RATIO * (self.sizes[rows] + size) * SLACK].tolist():
                if marks is None:
                    marks = mine.marks()
                    self.marked[marks] = True
                if self._may(text, mine, i) and similar(text, self.texts[self.long[i]]):
                    self.marked[marks] = False
                    return self.long[i]
        if marks is not None:
            self.marked[marks] = False
        return found

    def _may(self, text: str, mine: _Features, i: int) -> bool:
        """The tighter bound: from a rare character, a block reaches at most three characters on and two back, or holds
        substrings around it that ``text`` has too."""
        lead, slots, gains = self.others[i]
        other = self.texts[self.long[i]]
        rare = np.minimum(self.counts[i, :CHARS], mine.counts[:CHARS]).sum() / 3
        begin = len(os.path.commonprefix([text[:lead], other[:lead]]))
        return 2.0 * (begin + 5 * rare + gains[self.marked[slots]].sum()) >= RATIO * (len(text) + len(other)) * SLACK


def collapse(rows: DataFrame, block: str = "source") -> DataFrame:
    """Section rows (block, doc_id, n, body) with ``kept``: near-duplicates of a kept section before them go.

    A section stays if it has two sentences of its own, or if it is the largest of a document that would lose all.
    The greedy pass needs the order of a block (a knowledge base has hundreds of sections), so blocks are the unit.
    """

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["doc_id", "n"], kind="stable").reset_index(drop=True)
        kept = Kept()
        seen: dict[str, tuple[int, int | None]] = {}  # of each text: how many kept sections it was held against, and its twin
        marks = []
        for body in part["body"]:
            mine = flat(body)
            start, twin = seen.get(mine, (0, None))
            if twin is None:
                twin = kept.first(mine, start)
            seen[mine] = (len(kept.texts), twin)
            stays = twin is None or sum(s.lower() not in kept.pool(twin) for s in sentences(body)) >= OWN
            if stays:
                kept.add(mine, body)
            marks.append(stays)
        part["kept"] = marks
        sizes = part["body"].str.len()
        for _, group in part.groupby("doc_id", sort=False):
            if not group["kept"].any():
                part.loc[sizes.loc[group.index].idxmax(), "kept"] = True
        return part[[block, "doc_id", "n", "kept"]]

    fields = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {fields[c]}" for c in (block, "doc_id", "n")) + ", kept boolean"
    return rows.select(block, "doc_id", "n", "body").groupBy(block).applyInPandas(run, schema)


def index_fingerprint(chunks: DataFrame) -> DataFrame:
    """sha256 over the chunks' ids and texts in order, to notice a stale index."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "id", "text")))
    return chunks.agg(F.sha2(F.array_join(F.transform(ordered, lambda x: F.concat(x["id"], F.lit("\0"), x["text"], F.lit("\0"))), ""), 256).alias("fingerprint"))

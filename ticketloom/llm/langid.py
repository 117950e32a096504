"""Language identification by cross-parsing against suffix automata (operator 3).

For each language a suffix automaton of labelled text is built on the driver from
whole texts of a bounded number of rows. A text is parsed greedily against each
automaton: a phrase is the longest match from where the last one ended. Phrases
times the logarithm of the model's length estimate the cross entropy; the
language with the fewest normalised phrases wins. Every language that has labelled
text takes part, with its own letters.

All texts of a batch take their steps together in numpy, from the first character
to the last; when few are left, each goes on alone from its state, so that very long
texts are parsed in one piece too. A letter that no phrase can begin with is a
phrase by itself.

Defined results: null texts and texts without letters are ``und`` with score 0;
ties go to the language that sorts first; without labelled rows every text is
``und``; repeated rows, and rows that share a doc_id, get equal results for equal
texts; a null doc_id is never held out and never trained on; an empty table gives
no rows; columns named lang_pred or score are replaced, others pass through; only
text is read for a prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketloom.llm.wordbuf import blocks

#: Labelled rows of each language whose whole texts its automaton is built from, at most.
MODEL_ROWS = 25
#: Shares of a language's labelled rows that are ranked apart.
SALTS = 256
#: Lanes (texts times languages) below which the texts that are left go on one by one.
ALONE = 160
#: Bytes of the rows of transitions, whatever the number of letters.
ROWS_BYTES = 24_000_000
#: Bytes of text that are parsed together.
BLOCK_BYTES = 6_000_000
UNDETERMINED = "und"
#: The symbol of a letter that no automaton has; those of letters begin at 2.
OTHER = 1


def held_out(modulus: int = 5) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0


def normalise(text: str) -> str:
    """Lower case letters, one space for all between them."""
    return " " + " ".join("".join([c if c.isalpha() else " " for c in text.lower()]).split()) + " "


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The arcs of each state of the automaton of all substrings; state 0 is the start."""
    link, length, arcs = [-1], [0], [{}]
    last = 0
    for c in codes:
        cur = len(arcs)
        arcs.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in arcs[p]:
            arcs[p][c] = cur
            p = link[p]
        if p >= 0:
            q = arcs[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(arcs)
                arcs.append(dict(arcs[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and arcs[p].get(c) == q:
                    arcs[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return arcs


class CrossParser:
    """Automata of all languages, one state after another.

    A state with one arc keeps its symbol and target. States with more have rows of targets by symbol, those with the
    most arcs first, as long as the rows take at most ``ROWS_BYTES``; the arcs of the others are in a sorted list.
    """

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.langs = sorted(texts)
        letters = sorted({c for parts in texts.values() for part in parts for c in part})
        self.code = {c: i + 2 for i, c in enumerate(letters)}
        self.width = width = len(letters) + 2
        arcs: list[dict[int, int]] = []
        starts = []
        for lang in self.langs:
            base = len(arcs)
            starts.append(base)
            arcs += [{c: base + to for c, to in out.items()} for out in suffix_automaton([self.code[c] for part in texts[lang] for c in part])]
        self.starts, self.dead = np.array(starts, np.int64), len(arcs)  # no arc leaves the dead state
        arcs.append({})
        sizes = np.fromiter(map(len, arcs), np.int64, len(arcs))
        self.symbol, self.target = np.full(len(arcs), -1, np.int32), np.full(len(arcs), -1, np.int32)
        for state in np.flatnonzero(sizes == 1).tolist():
            ((self.symbol[state], self.target[state]),) = arcs[state].items()
        many = np.flatnonzero(sizes > 1)
        many = many[np.argsort(-sizes[many], kind="stable")]
        rows = many[: max(len(starts), ROWS_BYTES // (4 * width))]
        self.row = np.zeros(len(arcs), np.int64)  # where a state's row begins
        self.row[rows] = np.arange(1, len(rows) + 1) * width
        self.moves = np.full((len(rows) + 1, width), -1, np.int32)
        for i, state in enumerate(rows.tolist(), 1):
            self.moves[i, list(arcs[state])] = list(arcs[state].values())
        left = sorted((state * width + c, to) for state in many[len(rows) :].tolist() for c, to in arcs[state].items())
        self.listed, self.listed_to = (np.array([x[i] for x in left], np.int64) for i in (0, 1))
        self.moves = self.moves.ravel()
        self.begin = np.stack([self.find(np.full(width, start), np.arange(width)) for start in starts]) if starts else np.zeros((0, width), np.int32)
        self.cost = np.array([np.log2(max(2, sum(map(len, texts[lang])))) for lang in self.langs])

    def find(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where the arcs lead; -1 where there is none."""
        to = self.moves.take(self.row.take(state) + symbol)
        np.copyto(to, self.target.take(state), where=self.symbol.take(state) == symbol)
        if len(self.listed):
            key = state * np.int64(self.width) + symbol
            at = np.minimum(np.searchsorted(self.listed, key), len(self.listed) - 1)
            to = np.where(self.listed[at] == key, self.listed_to[at], to)
        return to

    @property
    def flat(self) -> np.ndarray:
        """The symbol of each code point; those that are no letters are gaps."""
        if not hasattr(self, "_flat"):
            self.gap = self.code.get(" ", 0)
            alpha = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
            self._flat = np.where(alpha, OTHER, self.gap).astype(np.uint16 if self.width < 1 << 16 else np.int32)
            for c, i in self.code.items():
                self._flat[ord(c)] = i
        return self._flat

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_flat", "gap")}

    def symbols(self, text: str | None) -> np.ndarray:
        """As normalise() has it, in symbols."""
        x = self.flat[np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)]
        space = x == self.gap
        return x[~(space & np.concatenate([[False], space[:-1]]))]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text in each language."""
        k, n = len(self.langs), len(texts)
        sizes = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        alone = min(n, ALONE // max(1, k))
        steps = int(sizes[alone]) if alone < n else 0  # beyond, so few texts are left that each goes on alone
        grid = np.concatenate([x[:steps] for x in (texts[i] for i in order.tolist())]) if n else np.zeros(0, np.uint16)
        held = np.minimum(sizes, steps)
        first = np.cumsum(held) - held
        state = np.repeat(self.starts[None, :].astype(np.int32), n, 0).ravel()  # of each text, of each language
        count = np.zeros(n * k, np.int32)
        begin = np.where(self.begin < 0, self.dead, self.begin).astype(np.int32).ravel()  # where a new phrase leads
        row_of = np.tile(np.arange(k) * self.width, n)
        lengths = -sizes
        for i in range(steps):
            live = int(np.searchsorted(lengths, -i, "left"))  # those longer than i
            symbol = np.repeat(grid.take(first[:live] + i), k)
            to = self.find(state[: live * k], symbol)
            stuck = np.flatnonzero(to < 0)
            if len(stuck):
                count[stuck] += 1
                to[stuck] = begin.take(row_of.take(stuck) + symbol.take(stuck))
            state[: live * k] = to
        count, state = count.reshape(n, k), state.reshape(n, k)
        for j in range(alone):
            rest = texts[order[j]][steps:].tolist()
            for lang in range(k):
                count[j, lang] += self._parse(lang, int(state[j, lang]), rest, begin)
        out = np.zeros((n, k))
        out[order] = count + 1
        return out

    def _parse(self, lang: int, state: int, rest: list[int], begin: np.ndarray) -> int:
        """Phrases that begin in the rest of a text, from a state on."""
        found, width, starts = 0, self.width, begin[lang * self.width : (lang + 1) * self.width].tolist()
        symbols, targets, row, moves = memoryview(self.symbol), memoryview(self.target), memoryview(self.row), memoryview(self.moves)
        listed = dict(zip(self.listed.tolist(), self.listed_to.tolist(), strict=True))
        for symbol in rest:
            if symbols[state] == symbol:
                to = targets[state]
            elif (to := moves[row[state] + symbol]) < 0 and listed:
                to = listed.get(state * width + symbol, -1)
            if to < 0:
                found += 1
                to = starts[symbol]
            state = to
        return found

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        clean = [self.symbols(t) for t in texts]
        found: list[tuple[str, float]] = [(UNDETERMINED, 0.0)] * len(texts)
        if not self.langs:
            return found
        asked = [i for i, t in enumerate(clean) if len(t) > 1]
        bits = self.phrases([clean[i] for i in asked]) * self.cost
        for row, i in enumerate(asked):
            b = bits[row]
            best = int(np.argmin(b))
            odds = np.exp2(np.maximum(b.min() - b, -1000.0) / max(1.0, len(clean[i]) / 64))
            found[i] = (self.langs[best], float(1 / odds.sum()))
        return found


def sample(rows: DataFrame, group: str, wanted: Column, key: str = "doc_id") -> DataFrame:
    """Of each group the ``wanted`` rows first in the order of a hash of their key: group, key.

    Rows are ranked within ``SALTS`` shares of each group first, so that no task ranks a large group whole.
    """
    place = F.pmod(F.xxhash64(key), F.lit(1 << 30)) / float(1 << 30)
    near = rows.select(group, key, place.alias("loom_place"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("loom_salt"))
    for parts in ([group, "loom_salt"], [group]):
        order = Window.partitionBy(*parts).orderBy("loom_place", key)
        near = near.withColumn("loom_rank", F.row_number().over(order)).filter(F.col("loom_rank") <= wanted).drop("loom_rank")
    return near.select(group, key)


def train(labelled: DataFrame) -> CrossParser:
    """Automata from rows with text and lang: of each language the whole texts of the first ``MODEL_ROWS`` in hash order."""
    rows = labelled.filter("lang is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    chosen = sample(rows.filter(F.length("text") > 0).select("lang", "doc_id"), "lang", F.lit(MODEL_ROWS))
    held: dict[str, set[str]] = {}
    for r in rows.join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi").toLocalIterator():  # MODEL_ROWS of each language
        held.setdefault(r["lang"], set()).add(normalise(r["text"] or ""))
    texts = {lang: parts for lang, found in held.items() if (parts := sorted(t for t in found if len(t) > 2))}
    return CrossParser(texts)


def identify(docs: DataFrame, model: CrossParser) -> DataFrame:
    """lang_pred and score of each row, beside the columns of ``docs`` (in place of any with these names)."""
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # automata of MODEL_ROWS texts of each language
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ((t,) for t in batch.column(at).cast(pa.string()).to_pylist())
            found = [x for held in blocks(texts, BLOCK_BYTES) for x in shared.value.predict([t for (t,) in held])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)

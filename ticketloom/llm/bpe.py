"""BPE encoding and decoding with a tokenization automaton (operator 4).

A merge list is compiled into a deterministic automaton over tokens that accepts
exactly the correct tokenizations. It starts as one state with an arc for each
base symbol and takes one gadget for each merge ``u v -> t``, in order: the state
behind ``u`` loses its arc ``v`` (after it is split off, if other tokens lead to
the same state), and every state with an arc ``u`` gets an arc ``t`` to where
``v`` leads. All arcs of one label keep one target, so an arc of a state need
not be stored: whether ``p`` has ``t`` follows from whether ``p`` had ``u`` when
``t`` was made and from the removals since. Encoding walks a byte trie of arc
labels and the automaton together; for each word exactly one path is accepted.
Decoding emits the labels of the arcs.

Defined results: a null text is the empty text (no ids, empty decoded text);
rows with equal doc_id are encoded one by one; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Chunks without white space whose ids are kept; a gap of white space always ends a pre-split word.
CHUNK_CACHE = 120_000
#: Rows of the transition tables that are kept; they are rebuilt when needed.
ROW_CACHE = 100_000
#: Bytes of a word, and different bytes, that the tables take; other words go byte by byte.
TABLE_WIDTH, COLUMNS = 32, 112
#: Bytes of text that are looked up at once.
BLOCK_BYTES = 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in table:
            table[b] = chr(extra)
            extra += 1
    return [table[b] for b in range(256)]


class MergeAutomaton:
    """Deterministic automaton of the correct tokenizations of one merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "</w>") -> None:
        self.label = {i: s for s, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.left = [-1] * size
        self.made = [0] * size  # the merge that made a token, 0 for base symbols
        self.origin = [(-1, 0)]  # of each state: the state it was split from, and when
        self.removed: list[dict[int, int]] = [{}]
        self.target = [0] * size
        shared = {0: size + 1}  # labels that lead to a state; the start counts as one more
        for time, (a, b) in enumerate(merges, 1):
            u, v, t = vocab[a], vocab[b], vocab[a + b]
            q = self.target[u]
            self.left[t], self.made[t] = u, time
            if not self._has(q, v, time - 1):
                self.left[t], self.made[t] = u, 1 << 60  # never produced
                continue
            goal = self.target[v]
            if shared[q] > 1:
                shared[q] -= 1
                self.origin.append((q, time))
                self.removed.append({v: time})
                self.target[u] = len(self.origin) - 1
                shared[self.target[u]] = 1
            elif u == v:  # a a -> t: the state behind t keeps the arc that the one behind a loses
                self.origin.append((q, time))
                self.removed.append({})
                goal = len(self.origin) - 1
                shared[goal] = 0
                self.removed[q][v] = time
            else:
                self.removed[q][v] = time
            shared[self.target[t]] -= 1
            self.target[t] = goal
            shared[goal] += 1
        self._tables(vocab, merges, suffix)

    def _has(self, state: int, token: int, time: int) -> bool:
        """Whether ``state`` has an arc ``token`` after the merge ``time``."""
        while True:
            if self.made[token] > time:
                return False
            gone = self.removed[state].get(token)
            if gone is not None and gone <= time:
                return False
            origin, split = self.origin[state]
            if self.made[token] < split:
                state, time = origin, split - 1
            elif self.left[token] < 0:
                return True
            else:
                token, time = self.left[token], self.made[token]

    def _tables(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        """A byte trie of the arc labels, and for each label what decides whether an arc is there.

        ``p`` behind label ``a`` lost its arc ``x`` at merge ``k`` if ``k`` joins ``x`` to ``a`` or to one of the
        right parts that ``a`` still shared its state with; ``t`` needed its left part when it was made. So an
        arc ``t`` behind ``a`` is missing if a merge joins a right part of ``a`` and a left part of ``t`` in time.
        """
        code = {s: b for b, s in enumerate(byte_symbols())}
        self.step: dict[int, int] = {}
        self.inner, self.final = [-1], [-1]
        for text, i in vocab.items():
            last, node = text.endswith(suffix), 0
            for c in text.removesuffix(suffix) if last else text:
                key = node << 8 | code[c]
                if key not in self.step:
                    self.step[key] = len(self.inner)
                    self.inner.append(-1)
                    self.final.append(-1)
                node = self.step[key]
            (self.final if last else self.inner)[node] = i
        self.sizes = np.zeros(len(self.made), np.int64)
        for text, i in vocab.items():
            self.sizes[i] = len(text.removesuffix(suffix))
        self.join = {vocab[a] << 20 | vocab[b]: k for k, (a, b) in enumerate(merges, 1)}
        self.right = [-1] * len(self.made)
        for a, b in merges:
            self.right[vocab[a + b]] = vocab[b]
        self.parents = {key >> 8 for key in self.step}
        self.like = [0] * len(self.made)  # one label for each set of labels that lead to the same state
        first: dict[int, int] = {}
        for t in range(len(self.made)):
            self.like[t] = first.setdefault(self.target[t], t)
        self._reset()

    def _reset(self) -> None:
        """Empty transition tables; rows are added as texts need them."""
        self.rows: list[tuple[tuple[int, int], ...]] = [((0, -1),)]
        self.row_of: dict[tuple, int] = {}
        kind = np.uint16 if len(self.made) < 65535 else np.int32
        self.lacking = {"moves": -1, "stops": np.iinfo(kind).max}  # what marks an entry that is not there yet
        self.moves = np.full((1024, COLUMNS // 2), -1, np.int32)
        self.stops = np.full((1024, COLUMNS // 2), self.lacking["stops"], kind)
        self.ends = np.zeros(1024, np.int32)  # of each row: the label that ends there
        self.column = np.full(256, -1, np.int16)  # of each byte, as they come up
        self.column[list(b"abcdefghijklmnopqrstuvwxyz0123456789.,!?")] = np.arange(40)
        self.columns = 40

    def _move(self, row: int, byte: int) -> int:
        """The row after one more byte: all labels begun (trie node, label before), and the one that ends here."""
        items, label = [], -1
        for node, before in self.rows[row]:
            node = self.step.get(node << 8 | byte)
            if node is None:
                continue
            token = self.inner[node]
            if label < 0 and token >= 0 and self._arc(before, token):
                label = token
            if node in self.parents:
                items.append((node, before))
        key = (*items, (0, self.like[label])), label
        number = self.row_of.get(key)
        if number is None:
            number = self.row_of[key] = len(self.rows)
            self.rows.append(key[0])
            if number == len(self.ends):
                self._grow(number // 2, 0)
                self.ends = np.concatenate([self.ends, np.zeros(number // 2, np.int32)])
            self.ends[number] = label
        return number

    def _grow(self, rows: int, columns: int) -> None:
        """More room in the transition tables."""
        for name, mark in self.lacking.items():
            table = getattr(self, name)
            setattr(self, name, np.pad(table, ((0, rows), (0, columns)), constant_values=mark))

    def _stop(self, row: int, byte: int) -> int:
        """The label that ends the word with this byte."""
        for node, before in self.rows[row]:
            node = self.step.get(node << 8 | byte)
            if node is not None and (token := self.final[node]) >= 0 and self._arc(before, token):
                return token
        raise ValueError("no accepted path ends here")

    def _arc(self, before: int, token: int) -> bool:
        """Whether the state behind ``before`` (-1: the start) has an arc ``token``."""
        if before < 0:
            return self.made[token] < 1 << 59
        made, left, right, find = self.made, self.left, self.right, self.join.get
        a, limit_a = before, 1 << 59
        while a >= 0:
            t, limit_t = token, 1 << 59
            while t >= 0:
                k = find(a << 20 | t)
                if k is not None and k < limit_a and k <= limit_t:
                    return False
                limit_t, t = made[t], left[t]
            limit_a, a = made[a], right[a]
        return True

    def _look_up(self, name: str, fill, rows: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Entries of a table; those that are not there yet are worked out once each."""
        columns = self.column[codes]
        found = getattr(self, name)[rows, columns]
        if len(lacking := np.flatnonzero(found == self.lacking[name])):
            keys = np.unique(rows[lacking].astype(np.int64) << 8 | codes[lacking])
            values = [fill(k >> 8, k & 255) for k in keys.tolist()]
            getattr(self, name)[keys >> 8, self.column[keys & 255]] = values
            found = getattr(self, name)[rows, columns]
        return found

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """For each word the labels of the only accepted path that spells it, as little-endian 32-bit ids.

        All words move through the transition tables together, a byte at a time; then the labels are read
        off backwards.
        """
        if len(self.rows) > ROW_CACHE:
            self._reset()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out: list[bytes] = [b""] * len(words)
        short = np.flatnonzero((sizes > 0) & (sizes <= TABLE_WIDTH))
        if len(short):
            short = short[np.argsort(-sizes[short], kind="stable")]
            n = sizes[short]
            text = np.frombuffer(b"".join([words[i].ljust(TABLE_WIDTH, b"\0") for i in short.tolist()]), np.uint8).reshape(-1, TABLE_WIDTH)
            seen = np.unique(text)
            new = seen[(self.column[seen] < 0) & (seen > 0)]
            if self.columns + len(new) > COLUMNS:  # too many bytes for one table: word by word
                return [self.encode(w) for w in words]
            self.column[new] = np.arange(self.columns, self.columns + len(new))
            self.columns += len(new)
            if self.columns > self.moves.shape[1]:
                self._grow(0, min(COLUMNS, self.columns + 8) - self.moves.shape[1])
            ends = np.zeros(text.shape, np.int32)  # the label that ends at each position
            row = np.zeros(len(short), np.int32)
            for i in range(int(n[0])):
                last, more = int(np.searchsorted(-n, -i - 1, "left")), int(np.searchsorted(-n, -i - 1, "right"))
                if more > last:
                    ends[last:more, i] = self._look_up("stops", self._stop, row[last:more], text[last:more, i])
                if last:
                    row[:last] = self._look_up("moves", self._move, row[:last], text[:last, i])
                    ends[:last, i] = self.ends[row[:last]]
            labels, at, each = [], n.copy(), np.arange(len(short))
            live = each
            while len(live):
                label = ends[live, at[live] - 1]
                labels.append((live, label))
                at[live] -= self.sizes[label]
                live = live[at[live] > 0]
            who = np.concatenate([x for x, _ in labels])
            what = np.concatenate([x for _, x in labels])[np.lexsort((-np.repeat(np.arange(len(labels)), [len(x) for x, _ in labels]), who))]
            packed = what.astype("<u4").tobytes()
            bounds = (np.cumsum(np.bincount(who, minlength=len(short))) * 4).tolist()
            for i, a, b in zip(short.tolist(), [0, *bounds], bounds, strict=False):
                out[i] = packed[a:b]
        for i in np.flatnonzero(sizes > TABLE_WIDTH).tolist():
            out[i] = self.encode(words[i])
        return out

    def encode(self, word: bytes) -> bytes:
        """One word of any length, by the same automaton."""
        rows, row = [], 0
        moved: dict[tuple[int, int], int] = {}
        if len(self.rows) > ROW_CACHE:
            self._reset()
        for byte in word[:-1]:
            row = moved[row, byte] if (row, byte) in moved else moved.setdefault((row, byte), self._move(row, byte))
            rows.append(row)
        found, at = [], len(word)
        while at > 0:
            found.append(self._stop(row, word[-1]) if at == len(word) else int(self.ends[rows[at - 1]]))
            at -= int(self.sizes[found[-1]])
        return np.array(found[::-1], "<u4").tobytes()


class WordBpe:
    """A tokenizer file with word ends: normalisation, pre-split and automaton."""

    def __init__(self, spec: bytes) -> None:
        data = json.loads(spec)
        model = data["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"]
        self.automaton = MergeAutomaton(model["vocab"], merges, self.suffix)
        pattern = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.space = regex.compile(r"\p{White_Space}+")
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.labels = self.automaton.label | {i: s for s, i in self.special.items()}
        self.said = {i: x.encode() for i, x in self.labels.items()}
        self.ids: dict[bytes, bytes] = {}  # by chunk, and the generation before
        self.old: dict[bytes, bytes] = {}

    def _pieces(self, chunk: bytes) -> list[bytes | int]:
        """The pre-split words of a chunk; ids of special tokens stand for themselves."""
        text = chunk.decode()
        parts = self.specials.split(text) if self.specials and "<|" in text else [text]
        out: list[bytes | int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            if not part.isascii():
                part = self.space.sub(" ", unicodedata.normalize("NFC", part)).replace("Σ", "σ")
            out += [w.encode() for w in self.words.findall(part.lower())]
        return out

    def _learn(self, chunks: set[bytes]) -> None:
        """Encode chunks that are not known yet, all at once."""
        again = chunks & self.old.keys()
        ids, old = self.ids, self.old
        for chunk in again:
            ids[chunk] = old[chunk]
        whole: dict[bytes, bytes] = {}  # chunks that are one word
        split: dict[bytes, list[bytes | int] | tuple[bytes, bytes]] = {}
        for chunk in chunks - again:  # the common forms without the pattern: ASCII letters, and letters before punctuation
            low = chunk.lower()
            core = low.rstrip(b".,!?;:")
            if not core.isalpha():
                split[chunk] = self._pieces(chunk)
            elif len(core) == len(low):
                whole[chunk] = low
            else:
                split[chunk] = (core, low[len(core) :])
        words = {*whole.values(), *(w for ws in split.values() for w in ws if isinstance(w, bytes))}
        listed = list(words)
        known = dict(zip(listed, self.automaton.encode_words(listed), strict=True))
        for chunk, word in whole.items():
            ids[chunk] = known[word]
        for chunk, ws in split.items():
            ids[chunk] = known[ws[0]] + known[ws[1]] if isinstance(ws, tuple) else b"".join([known[w] if isinstance(w, bytes) else w.to_bytes(4, "little") for w in ws])

    def encode_all(self, texts: Iterable[bytes | None]) -> Iterator[list[bytes]]:
        """For each text the ids of its chunks, as little-endian unsigned 32-bit integers."""
        held: list[list[bytes]] = []
        size = 0
        for text in texts:
            held.append((text or b"").split())
            size += len(text or b"")
            if size > BLOCK_BYTES:
                yield from self._flush(held)
                held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[list[bytes]]) -> Iterator[list[bytes]]:
        if len(self.ids) > CHUNK_CACHE:
            self.old, self.ids = self.ids, {}
        get = self.ids.get
        found = [list(map(get, chunks)) for chunks in held]
        lacking = [i for i, parts in enumerate(found) if None in parts]
        new = {c for i in lacking for c, x in zip(held[i], found[i], strict=True) if x is None}
        if new:
            self._learn(new)
            for i in lacking:
                found[i] = list(map(get, held[i]))
        yield from found

    def forget(self) -> None:
        """Give back what was kept for later texts."""
        self.ids, self.old = {}, {}
        self.automaton._reset()
        gc.collect()

    def encode(self, text: bytes) -> bytes:
        return b"".join(next(self.encode_all([text])))

    def decode(self, ids: bytes) -> bytes:
        """The labels of ids, joined as the library's decode joins them."""
        return b" ".join(map(self.said.__getitem__, memoryview(ids).cast("I")))


_LOADED: dict[str, WordBpe] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def read_spec(path: str) -> bytes:
    """The tokenizer file, read once on the driver and sent to the workers (its size does not grow with the data)."""
    with open(path, "rb") as file:
        return file.read()


def tokenizer(spec: bytes) -> WordBpe:
    """The compiled tokenizer; one for each worker process."""
    key = hashlib.sha256(spec).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordBpe(spec)
        gc.freeze()  # the tables live as long as the worker; collections need not walk them
        gc.set_threshold(200_000, 50, 1000)
    return _LOADED[key]


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, decoded on request)."""
    spark: SparkSession = docs.sparkSession
    spec = spark.sparkContext.broadcast(read_spec(path or default_tokenizer()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(spec.value)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            texts = (x.as_py() for x in batch.column(1).cast(pa.binary()))
            for parts in bpe.encode_all(texts):
                ids = b"".join(parts)
                said = bpe.decode(ids)
                for column, value in zip(out, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(said).hexdigest(), ids if with_ids else None, said.decode() if with_ids else None), strict=True):
                    column.append(value)
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns += [pa.array(out[3], pa.binary()), pa.array(out[4], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_ids
    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def crc_pieces(ids: bytes, cuts: list[tuple[int, int]]) -> list[int]:
    """crc32 of each piece (start and length in ids)."""
    view = memoryview(ids)
    return [zlib.crc32(view[4 * a : 4 * (a + n)]) for a, n in cuts]

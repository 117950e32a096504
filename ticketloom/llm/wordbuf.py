"""Words of many texts at once, as numpy arrays over one byte buffer.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return. Words have the two halves of their 128-bit XXH3 hash.
A window's hash is the sum of its words' hashes times powers of an odd constant
modulo 2**64, so that those of all windows of a buffer come from one running sum;
two constants over the two halves give two independent hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
from xxhash import xxh3_128_digest

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
U64 = np.uint64
#: Bytes that are hashed at once.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which each output bit depends on each input bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@cache
def constants(which: int) -> tuple[int, int]:
    """An odd base and its inverse modulo 2**64."""
    base = int(mix(np.array([which + 257], U64) * U64(0x9E3779B97F4A7C15))[0]) | 1
    return base, pow(base, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}
#: Tables of powers up to this length are kept by a worker.
KEPT_POWERS = 1 << 20


def powers(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n-1) modulo 2**64."""
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        size = 1 << max(16, (n - 1).bit_length())
        known = np.ones(size, U64)
        step = 1
        while step < size:  # doubling
            known[step : 2 * step] = known[:step] * U64(pow(base, step, 1 << 64))
            step *= 2
        if size <= KEPT_POWERS:
            _POWERS[base] = known
    return known[:n]


class WordBuffer:
    """The words of a list of texts (UTF-8 bytes; None is an empty text)."""

    def __init__(self, texts: list[bytes | None], lower: bool = False) -> None:
        texts = [t or b"" for t in texts]
        data = b"\n".join([*texts, b""])
        if lower:
            data = data.lower()  # A-Z alone
        self.data = data
        self.bytes = np.frombuffer(data, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.text_ends = np.cumsum(sizes)
        gap = SPACE[self.bytes]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            edge = np.concatenate([[0], edge])
        self.starts, self.ends = edge[0::2], edge[1::2]  # the buffer ends with a gap
        self.first = np.searchsorted(self.starts, np.concatenate([[0], self.text_ends]))  # first word of each text
        self.n_words = np.diff(self.first)
        self.hashes: np.ndarray | None = None

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.n_words)), self.n_words)

    def word_hashes(self, which: int) -> np.ndarray:
        if self.hashes is None:
            self.hashes = np.empty((len(self.starts), 2), U64)
            at, size = 0, len(self.data)
            lo = 0
            while at < size:  # so much at a time that few words are objects at once
                hi = size if size - at <= CHUNK else self._gap_after(at + CHUNK)
                words = self.data[at:hi].split()
                self.hashes[lo : lo + len(words)] = np.frombuffer(b"".join(map(xxh3_128_digest, words)), U64).reshape(-1, 2)
                lo, at = lo + len(words), hi
        return self.hashes[:, which].copy()

    def _gap_after(self, at: int) -> int:
        """Where the first word ends that reaches over ``at``."""
        k = int(np.searchsorted(self.ends, at))
        return int(self.ends[k]) if k < len(self.ends) else len(self.data)

    def windows(self, k: int) -> np.ndarray:
        """First words of all windows of ``k`` words that lie within one text."""
        last = np.repeat(self.first[1:], self.n_words)
        at = np.arange(len(last))
        return at[at + k <= last]


def window_hashes(words: np.ndarray, starts: np.ndarray, k: int, which: int) -> np.ndarray:
    """A hash of the ``k`` word hashes from each start on."""
    base, inverse = constants(which)
    n = len(words)
    run = np.zeros(n + 1, U64)
    np.cumsum(words * powers(base, n), out=run[1:])
    return mix((run[starts + k] - run[starts]) * powers(inverse, n + 1)[starts])


def blocks(rows: Iterable[tuple], size: int, text: int = -1) -> Iterator[list[tuple]]:
    """Rows in lists of about ``size`` bytes of text (more where one text is longer)."""
    held: list[tuple] = []
    total = 0
    for row in rows:
        held.append(row)
        total += len(row[text] or b"") + 1
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held

"""Vectorised text primitives over Arrow batches, shared by the operators that work in numpy.

Whole texts are cut into words on their UTF-8 bytes; words, lines and word windows are compared by
64-bit hashes (a polynomial over random byte codes with an odd base, finalised by a bit mixer).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SLICE_BYTES = 1 << 20


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def separator_table(kind: str) -> np.ndarray:
    """Which bytes part words: ``space`` (ASCII whitespace) or ``symbol`` (ASCII that is no letter or digit)."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[[0x20, *range(0x09, 0x0E)]] = True
    else:
        table[:128] = True
        for a, b in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
            table[a : b + 1] = False
    return table


@dataclass
class Words:
    """Words of a slice of texts: byte spans, the first word of each text, and the text of each word."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows of about ``limit`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, whole[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class TextKernel:
    """Cuts and hashes; made once in each task, since it keeps power tables."""

    def __init__(self, separators: str = "space", lower: bool = False):
        self.separators = separator_table(separators)
        self.codes = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=U64)
        self.fold = np.arange(256, dtype=np.uint8)
        if lower:
            self.fold[0x41:0x5B] += 0x20
        self._powers = (np.zeros(0, U64), np.zeros(0, U64))

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._powers[0]) < n:
            base = 0x9E3779B97F4A7C15
            grown = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(max(n, SLICE_BYTES), b, U64)
                p[0] = 1
                grown.append(np.multiply.accumulate(p))
            self._powers = (grown[0], grown[1])
        return self._powers[0][:n], self._powers[1][:n]

    def cut(self, buf: np.ndarray, offsets: np.ndarray) -> Words:
        buf = self.fold[buf]
        inside = ~self.separators[buf]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edge = offsets[1:-1]
        at = edge[edge < len(buf)]
        begins[at] = inside[at]  # a text's first byte begins a word even where no separator stands before it
        before = edge[edge > 0] - 1
        ends[before] = inside[before]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return Words(buf, offsets, start, end, np.searchsorted(start, offsets))

    def span_hashes(self, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each byte span."""
        power, inverse = self.powers(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, U64)
        np.cumsum(self.codes[buf] * power[: len(buf)], out=sums[1:])
        return mix64((sums[end] - sums[start]) * inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def word_hashes(self, words: Words) -> np.ndarray:
        return self.span_hashes(words.buf, words.start, words.end)


def window_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of all windows of ``k`` words that lie within one text."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    g = np.zeros(n, U64)
    for j in range(k):
        g = (g ^ h[j : j + n]) * U64(0x9FB21C651E98DF25)
        g ^= g >> U64(29)
    ends = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + k <= ends)
    return at, mix64(g[at])


def sums_by_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def covered(at: np.ndarray, length: np.ndarray | int, n: int) -> np.ndarray:
    """Which of n places lie in a span [at, at + length)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + length, -1)
    return np.cumsum(step[:-1]) > 0


def dense_ranks(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks from 0 of rows by the keys in order of weight, equal rows sharing one; and each rank's count."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    dense = np.cumsum(new)
    ranks = np.empty(len(order), np.int64)
    ranks[order] = dense
    return ranks, np.bincount(dense)

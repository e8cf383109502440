"""Texts cut into units that tokenizers encode apart, each distinct unit encoded once.

A unit ends at a single space between two characters that are neither white space nor U+2581.  Word and
byte-level BPE split their input there before any merge, and no piece of a sentencepiece BPE has U+2581
behind another character, so the tokens of a text are the tokens of its units in order.  The space goes:
word BPE drops it, a byte-level BPE gets it before its unit, and sentencepiece adds one to each unit.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np

CUT = re.compile(r" (?=[^\s▁])(?<=[^\s▁] )")
BLOCK_CHARS = 1 << 20
#: Units that a table keeps from one block to the next, and the longest that it keeps, in characters.
TABLE_UNITS = 1 << 20
LONG_UNIT = 1 << 12


def tokenizer_file(name: str) -> str:
    """An absolute path as it is; a bare name among the public tokenizers of this machine."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def word_tokenizer(name: str, specials_are_text: bool):
    """A tokenizer of the library ``tokenizers`` that starts no threads of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(tokenizer_file(name))
    found.encode_special_tokens = specials_are_text
    return found


def byte_level_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def units(text: str) -> list[str]:
    return CUT.split(text) if text else []


def blocks(text: str, size: int = BLOCK_CHARS) -> Iterator[str]:
    """Pieces of about ``size`` characters whose units, in order, are the text's units."""
    at = 0
    while len(text) - at > size:
        found = CUT.search(text, at + size)
        if found is None:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


def unit_slices(texts: list[str | None], size: int = BLOCK_CHARS, cut: Callable[[str], list[str]] = units) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(row of each unit, units) of runs of whole blocks of about ``size`` characters; null and empty texts have none."""
    rows: list[int] = []
    counts: list[int] = []
    found: list[str] = []
    held = 0
    for row, text in enumerate(texts):
        if not text:
            continue
        for block in blocks(text, size):
            got = cut(block)
            rows.append(row)
            counts.append(len(got))
            found += got
            held += len(block)
            if held >= size:
                yield np.repeat(rows, counts), found
                rows, counts, found, held = [], [], [], 0
    if rows:
        yield np.repeat(rows, counts), found


def runs_of(found: list[str], chars: int) -> Iterator[list[str]]:
    """Consecutive units of about ``chars`` characters together; one that no cut may border (white space at the edge of a text) alone."""
    first, held = 0, 0
    for i, u in enumerate(found):
        if any(c.isspace() or c == "▁" for c in (u[0], u[-1])):
            if first < i:
                yield found[first:i]
            yield [u]
            first, held = i + 1, 0
            continue
        held += len(u) + 1
        if held >= chars:
            yield found[first : i + 1]
            first, held = i + 1, 0
    if first < len(found):
        yield found[first:]


class Numbers(dict):
    """Numbers in order of first use; ``new`` lists the units that came since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class UnitTable:
    """Numbers for units; ``encode`` is told the units new to the table, in order of their numbers.

    When the table is full, or has held a long unit, it is emptied before the next block, and ``reset`` is called.
    """

    def __init__(self, encode: Callable[[list[str]], None], reset: Callable[[], None], most: int = TABLE_UNITS):
        self.encode, self.reset, self.most = encode, reset, most
        self.number = Numbers()
        self.long = False

    def numbers(self, found: list[str]) -> np.ndarray:
        if self.long or len(self.number) > self.most:
            self.number.clear()
            self.long = False
            self.reset()
        got = np.fromiter(map(self.number.__getitem__, found), np.int64, len(found))
        if new := self.number.new:
            self.long = max(map(len, new)) > LONG_UNIT
            self.encode(new)
            self.number.new = []
        return got


class Ragged:
    """Lists of numbers of unequal length that grow at the end; ``take`` joins chosen ones."""

    def __init__(self, dtype: type = np.int64):
        self.dtype = dtype
        self.clear()

    def clear(self) -> None:
        self.flat, self.start = np.empty(0, self.dtype), np.zeros(1, np.int64)

    def extend_flat(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])
        self.flat = np.concatenate([self.flat, flat])

    def lengths(self, chosen: np.ndarray) -> np.ndarray:
        return self.start[chosen + 1] - self.start[chosen]

    def take(self, chosen: np.ndarray) -> np.ndarray:
        n = self.lengths(chosen)
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[chosen] - (ends - n), n)
        return self.flat[at]

"""Words and their hashes of many texts at once, by numpy over one byte array.

A word is a run of letters, digits and their marks; punctuation, symbols and spaces of any script part words.  In scripts
that write no blanks between words (Chinese, Japanese, Thai, Lao, Burmese, Khmer) every character is a word.  Case is
folded for ASCII and Latin-1 letters, which keeps every byte's place, so words know their place in the text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = True
_WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)


#: Blocks whose characters are words of their own.
_ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3021, 0x3029), (0x3038, 0x303B), (0x3040, 0x30FF), (0x31F0, 0x31FF),
          (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x1AFF0, 0x1B16F), (0x20000, 0x3FFFF))


@lru_cache
def _kinds() -> np.ndarray:
    """Of every character: 0 parts words, 1 is part of a word, 2 is a word of its own."""
    kinds = np.zeros(0x110000, np.uint8)
    # Above the planes with characters: private use, part of words like other unassigned characters.
    kinds[0x40000:] = 1
    kinds[:0x40000] = [unicodedata.category(chr(c))[0] not in "PZS" for c in range(0x40000)]
    for first, last in _ALONE:
        kinds[first : last + 1] *= 2
    kinds[[0x200B, 0x2060, 0xFEFF]] = 0  # of no width
    kinds[0x80:0xA0] = 0
    return kinds


def _characters(data: np.ndarray, inside: np.ndarray, alone: np.ndarray) -> None:
    """Sets whether bytes of characters beyond ASCII are inside of words, and marks the first ones of characters alone."""
    lead = np.flatnonzero(data >= 0xC0)
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
    code = data[lead].astype(np.int64) & (0xFF >> (size + 1))
    for k in (1, 2, 3):
        more = size > k
        code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
    kind = _kinds()[code]
    for k in range(4):
        inside[lead[(size > k) & (kind == 0)] + k] = False
    alone[lead[kind == 2]] = True
    alone[(lead + size)[kind == 2]] = True


class Powers:
    """Powers of the hash's base and of its inverse modulo 2**64, as far as needed."""

    def __init__(self, base: int = _BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U(pow(self.inverse, k, 1 << 64))])


_BYTES, _WORDS, _CHECKS = Powers(), Powers(0xD1342543DE82EF95), Powers(0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(values: np.ndarray, powers: Powers) -> np.ndarray:
    """Running sums from which span() takes the hash of any stretch."""
    powers.need(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.up[: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    return mix((sums[end] - sums[start]) * powers.down[start])


class Batch:
    """A few texts as one byte array with the places and hashes of their words.

    text[i] is data[at[i]:at[i+1]]; its words are number first[i] to first[i+1].
    """

    def __init__(self, texts: list[bytes]):
        self._read(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64))

    @classmethod
    def of(cls, data: np.ndarray, at: np.ndarray) -> "Batch":
        """The texts data[at[i]:at[i+1]], which begin and end with data."""
        out = cls.__new__(cls)
        out._read(data, at)
        return out

    def _read(self, data: np.ndarray, at: np.ndarray) -> None:
        self.data, self.at = data, at
        n = len(self.data)
        low = _LOWER[self.data]
        if n and self.data.max() >= 128:
            upper = (self.data[1:] >= 0x80) & (self.data[1:] <= 0x9E) & (self.data[1:] != 0x97) & (self.data[:-1] == 0xC3)
            low[1:] += upper.astype(np.uint8) << 5
        inside = _WORD[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.at] = True
        if n and self.data.max() >= 128:
            _characters(self.data, inside, edge)
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, inside
        after = np.empty(n + 1, bool)
        after[:n], after[n] = inside, False
        self.start = np.flatnonzero(inside & (~before[:n] | edge[:n]))
        self.end = np.flatnonzero(inside & (~after[1:] | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.at)
        sums = prefix(_VALUE[low], _BYTES)
        self.word = span(sums, self.start, self.end, _BYTES)
        self._sums: np.ndarray | None = None
        self._others: np.ndarray | None = None

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs of words, by their first word and the word after the last; the length is part of it."""
        if self._sums is None:
            self._sums = prefix(self.word, _WORDS)
        return mix(span(self._sums, start, end, _WORDS) + (end - start).astype(np.uint64))

    def checks(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Second hashes of runs of words, of 32 bits, independent of the first ones."""
        if self._others is None:
            self._others = prefix(mix(~self.word), _CHECKS)
        return span(self._others, start, end, _CHECKS) >> U(32)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of n words that lies in one text."""
        if len(self.word) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        k = np.arange(len(self.word) - n + 1)
        text = np.searchsorted(self.first, k, side="right") - 1
        k = k[k + n <= self.first[text + 1]]
        return k, self.runs(k, k + n)

    def shingles(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of every run of n words; a text with fewer words, but some, has one run of all of them."""
        k, h = self.grams(n)
        count = np.diff(self.first)
        short = np.flatnonzero((count > 0) & (count < n))
        text = np.concatenate([np.searchsorted(self.first, k, side="right") - 1, short])
        return text, np.concatenate([h, self.runs(self.first[short], self.first[short + 1])])


def stretches(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, bytes, places) of an Arrow column of texts, about `most` bytes at a time and uncopied.

    Text i of a stretch is bytes[places[i]:places[i+1]]; null counts as empty.
    """
    if not len(column):
        return
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, raw = column.buffers()
    at = np.frombuffer(places, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = min(len(column), max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1))
        yield a, data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def arrow_batches(column: pa.Array) -> Iterator[tuple[int, Batch]]:
    """(number of the first text, batch) over all texts of an Arrow column."""
    for first, data, at in stretches(column):
        yield first, Batch.of(data, at)


def batches(texts: list[bytes], most: int = 1 << 19) -> Iterator[tuple[int, Batch]]:
    """(number of the first text, batch) over all texts, each batch of about `most` bytes."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i + 1 == len(texts):
            yield first, Batch(texts[first : i + 1])
            first, size = i + 1, 0


def encoded(texts) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]

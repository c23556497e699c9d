"""Texts as flat numpy arrays: code points, words, lines and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_MASK = (1 << 64) - 1
#: Odd factors of the rolling hashes, with their inverses modulo 2**64.
CHAR_BASE, WORD_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
CHAR_INVERSE, WORD_INVERSE = pow(CHAR_BASE, -1, 1 << 64), pow(WORD_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on uint64 that spreads every input bit over the output."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _MASK, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def rolling(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i; one entry more than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:], dtype=np.uint64)
    return out


def slices(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int) -> np.ndarray:
    """Hash of values[start:end], the same wherever the slice stands."""
    return (prefix[end] - prefix[start]) * powers(inverse, len(prefix))[start]


def pieces(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts with about `most` characters each; a longer text stands alone."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


#: Bytes of texts whose arrays stay near a core, where several tasks share a machine's memory.
NEAR = 1 << 17


def text_pieces(column: pa.Array, most: int = 1 << 19) -> Iterator[tuple[int, int, list]]:
    """Consecutive ranges of a column of texts with about `most` bytes each, and these texts; a longer text stands alone."""
    ends = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < len(ends):
        before = int(ends[a - 1]) if a else 0
        b = max(a + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield a, b, column.slice(a, b - a).to_pylist()
        a = b


class Words:
    """Words (runs of anything but ASCII white space) of some texts; a null text has none.

    start, end: places in the code points; doc: the text each word belongs to;
    key: a 64-bit hash of the word's characters.
    """

    def __init__(self, texts: list, lower_ascii: bool = False):
        texts = [t or "" for t in texts]
        self.n = len(texts)
        self.codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        if lower_ascii:
            self.codes = np.where((self.codes >= 65) & (self.codes <= 90), self.codes + 32, self.codes)
        self.bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        space = (self.codes == 32) | ((self.codes >= 9) & (self.codes <= 13))
        word = ~space
        first = word.copy()
        first[1:] &= space[:-1]
        inner = self.bounds[1:-1]
        inner = inner[inner < len(word)]
        first[inner] = word[inner]
        last = word.copy()
        last[:-1] &= space[1:]
        inner = inner[inner > 0]
        last[inner - 1] = word[inner - 1]
        self.word = word
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.doc = np.searchsorted(self.bounds, self.start, side="right") - 1
        self.prefix = rolling(mix(self.codes), CHAR_BASE)
        self.key = mix(slices(self.prefix, self.start, self.end, CHAR_INVERSE) + (self.end - self.start).astype(np.uint64))
        self.counts = np.bincount(self.doc, minlength=self.n)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """start, end and text of each line; lines end at \\n and at the end of a text."""
        breaks = np.flatnonzero(self.codes == 10)
        start = np.sort(np.concatenate([self.bounds[:-1], breaks + 1]))
        doc = np.sort(np.concatenate([np.arange(self.n), np.searchsorted(self.bounds, breaks, side="right") - 1]))
        end = np.where(np.append(doc[1:], -1) == doc, np.append(start[1:], 0) - 1, self.bounds[doc + 1])
        return start, end, doc

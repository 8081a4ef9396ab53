"""Words and rolling hashes of Arrow text columns, without a Python loop over words.

A word is a run of characters other than space and the control characters 9
to 13. Hashes are polynomials over a fixed random byte table modulo 2**64 with
a final mix, so equal words have equal hashes in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.RandomState(20240611).randint(0, 1 << 32, (2, 256)).astype(_U)
BYTE_TABLE = (_TABLE[0] << _U(32)) | _TABLE[1] | _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 12), base, _U)
        out[0] = 1
        with np.errstate(over="ignore"):
            _powers[base] = have = np.cumprod(out, dtype=_U)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, n + 1, column.offset * kind().itemsize).astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at * 0
    return np.frombuffer(data, np.uint8, at[-1] - at[0], at[0]), at - at[0]


def slices(batch: pa.RecordBatch, text: str = "text", most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text, one document at least."""
    column = batch.column(text)
    _, at = utf8(column)
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    pa.default_memory_pool().release_unused()  # a worker that waits for its next task should hold little


class Words:
    """The words of a text column: byte ranges, and the first word of each document."""

    def __init__(self, column: pa.Array, lower: bool = False):
        self.data, self.doc_bytes = utf8(column)
        if lower:
            self.data = _LOWER[self.data]
        n = len(self.data)
        inside = np.zeros(n + 1, bool)
        inside[:n] = ~_SPACE[self.data]
        before = np.zeros(n + 1, bool)
        before[1:] = inside[:-1]
        joints = self.doc_bytes[1:-1]
        before[joints[joints <= n]] = False  # a word ends with its document
        self.starts = np.flatnonzero(inside & ~before)
        after = np.zeros(n + 1, bool)
        after[:-1] = inside[1:]
        after[joints[joints > 0] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.doc_words = np.searchsorted(self.starts, self.doc_bytes)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc_words)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.doc_words) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each word."""
        with np.errstate(over="ignore"):
            return mix(range_hashes(BYTE_TABLE[self.data], self.starts, self.ends) ^ _U(0x51ED270B7A3F6C2D))


class RangeHash:
    """Polynomials of ranges of values, whatever their place."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.total = np.zeros(n + 1, _U)
        with np.errstate(over="ignore"):
            np.cumsum(values * powers(_BASE, n), dtype=_U, out=self.total[1:])
        self.back = powers(_INV, n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.total[ends] - self.total[starts]) * self.back[starts]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return RangeHash(values).of(starts, ends)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each place on; len(words) - n + 1 of them."""
    if len(words) < n:
        return np.zeros(0, _U)
    at = np.arange(len(words) - n + 1)
    return mix(range_hashes(words, at, at + n))


def gram_places(doc_words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams inside one document, and the number of each document's."""
    counts = np.maximum(np.diff(doc_words) - n + 1, 0)
    first = np.repeat(doc_words[:-1] - (np.cumsum(counts) - counts), counts)
    return first + np.arange(counts.sum()), counts


def segments(counts: np.ndarray) -> np.ndarray:
    """Offsets from counts."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out

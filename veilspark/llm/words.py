"""Words of whole texts as numpy arrays: spans, 64-bit hashes and shingles, for a batch of documents at a time.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r. A word's hash is a polynomial over random byte codes modulo 2**64,
taken from differences of prefix sums (Rabin-Karp), then mixed. Equal words have equal hashes in every task and run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# Bytes of text that are handled at once; a longer document is a slice of its own.
SLICE_BYTES = 1 << 20


def _odd(n: int) -> np.uint64:
    return np.uint64(n | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def numbers(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers, the same in every process."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


_CODE = numbers(256, 1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0xD1342543DE82EF95
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64 for i < n."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]))
        held = _POWERS[base] = (grow(np.uint64(base)), grow(np.uint64(pow(base, -1, 1 << 64))))
    return held[0][:n], held[1][:n]


def window_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int = _BASE) -> np.ndarray:
    """Rabin-Karp value of values[begin:end] for each pair, independent of where the window stands."""
    up, down = powers(len(values) + 1, base)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=sums[1:])
    return (sums[end] - sums[begin]) * down[begin]


@dataclass
class Slice:
    """Rows first..last of a batch: their bytes, and where each row begins and ends."""

    first: int
    last: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def rows(self) -> int:
        return self.last - self.first

    def text(self, row: int) -> bytes:
        return self.data[self.bounds[row] : self.bounds[row + 1]].tobytes()


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """Consecutive rows of about `most` bytes together; null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, len(texts))
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


@dataclass
class Words:
    """Words of a slice in order: first byte, byte after the last, row, hash; per row the number of its first word (and one more)."""

    begin: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    bounds: np.ndarray


def spans(s: Slice) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word. Words do not reach over the end of a row."""
    if not len(s.data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~_SPACE[s.data]
    cut = np.zeros(len(s.data) + 1, bool)
    cut[s.bounds] = True
    before = np.concatenate([[False], solid[:-1]])
    after = np.concatenate([solid[1:], [False]])
    return np.flatnonzero(solid & (~before | cut[:-1])), np.flatnonzero(solid & (~after | cut[1:])) + 1


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans that stand in order and apart, in pieces of about SLICE_BYTES."""
    out = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(end, begin[at] + SLICE_BYTES, "right")))
        low, high = begin[at], end[to - 1]
        out[at:to] = window_sums(_CODE[data[low:high]], begin[at:to] - low, end[at:to] - low)
        at = to
    return mix(out + (end - begin).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(s: Slice, lower: bool = False) -> Words:
    begin, end = spans(s)
    data = lowered(s.data) if lower else s.data
    row = np.searchsorted(s.bounds, begin, "right") - 1
    # Empty rows share a bound; searchsorted from the right gives the last of them, which holds the word.
    return Words(begin, end, row, span_hashes(data, begin, end), np.searchsorted(row, np.arange(s.rows + 1)))


def shingles(w: Words, size: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every run of `size` words of a row; with `short`, a row of fewer words is one shingle."""
    n = len(w.hash)
    count = np.diff(w.bounds)
    start = np.arange(max(0, n - size + 1))
    if len(start):
        start = start[w.row[start] == w.row[start + size - 1]]
    value = np.zeros(len(start), np.uint64)
    for k, factor in enumerate(numbers(size, 7)):
        value += w.hash[start + k] * _odd(int(factor))
    value, row = mix(value), w.row[start]
    if short and len(few := np.flatnonzero((count > 0) & (count < size))):
        whole = window_sums(w.hash, w.bounds[few], w.bounds[few + 1], 0xA0761D6478BD642F)
        value = np.concatenate([value, mix(whole + count[few].astype(np.uint64))])
        row = np.concatenate([row, few])
    return value, row


def distinct_per_row(value: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each row in ascending order, and where each row begins (and one more)."""
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return value[keep], np.searchsorted(row[keep], np.arange(rows + 1))


def at_starts(take: np.ufunc, value: np.ndarray, bounds: np.ndarray, empty) -> np.ndarray:
    """take over each row's values; `empty` for a row without any."""
    out = np.full((len(bounds) - 1, *value.shape[1:]), empty, value.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = take.reduceat(value, bounds[full], axis=0)
    return out

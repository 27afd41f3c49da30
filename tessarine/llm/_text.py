"""Vectorised hashing of words and character n-grams over Arrow string buffers.

Every function works on the UTF-8 bytes of a slice of rows. A range of bytes has
the hash ``(H[end] - H[start]) * P**-start`` where ``H`` is the prefix sum of
``byte * P**position`` modulo 2**64, so any number of ranges costs one gather.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}

ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[9, 10, 12, 13, 32]] = True
NOT_LETTER = np.ones(256, dtype=bool)
NOT_LETTER[65:91] = NOT_LETTER[97:123] = NOT_LETTER[128:] = False

#: Bytes of text that are worked on at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20


def mix64(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, for uint64 arrays."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _P), ("down", _P_INV)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES):
    """Row ranges (lo, hi) of at most ``limit`` bytes, or of one longer row."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


class Ranges:
    """Hashes of byte ranges of one slice."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=self._sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sums[end] - self._sums[start]) * self._down[start])


def words(data: np.ndarray, rows: np.ndarray, separator: np.ndarray = ASCII_SPACE):
    """Starts, ends and per-row pointers of the runs of bytes that are no separators.

    ``rows`` are the offsets of the rows in ``data``; no run crosses a row.
    """
    inside = ~separator[data]
    starts, ends = inside.copy(), inside.copy()
    if len(data):
        starts[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cut = rows[(rows > 0) & (rows < len(data))]
        starts[cut] |= inside[cut]
        ends[cut - 1] |= inside[cut - 1]
    s = np.flatnonzero(starts)
    return s, np.flatnonzero(ends) + 1, np.searchsorted(s, rows)


def rows_of(pointers: np.ndarray) -> np.ndarray:
    """The row of each item, of row pointers."""
    return np.repeat(np.arange(len(pointers) - 1), np.diff(pointers))


def spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the ranges ``starts[i] .. starts[i] + counts[i] - 1`` laid end to end."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - first[owner] + starts[owner]


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Positions of keys in a sorted table, -1 where missing."""
    if len(table) == 0:
        return np.full(len(keys), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


def shingles(word_hashes: np.ndarray, pointers: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each row.

    A row of fewer than n words, but at least one, has one shingle: all of them.
    """
    count = len(word_hashes)
    grams = np.zeros(count, dtype=np.uint64)
    factor = [np.uint64(pow(_P, 2 * k + 3, 1 << 64)) for k in range(n)]
    for k in range(n):
        grams[: count - k or None] += word_hashes[k:] * factor[k] if k < count else np.uint64(0)
    grams = mix64(grams)
    out = []
    for lo, hi in zip(pointers[:-1].tolist(), pointers[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(grams[lo : hi - n + 1]))
        elif hi > lo:
            part = sum((int(word_hashes[lo + k]) * int(factor[k]) for k in range(hi - lo)), hi - lo)
            out.append(mix64(np.array([part % (1 << 64)], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out

"""Hashes of all words of a batch of texts, computed on whole byte arrays.

A word is a longest run of bytes other than space and 0x09-0x0D. Its hash is a polynomial
over the ring of 64-bit integers, taken as a difference of prefix sums and then mixed.
"""

from __future__ import annotations

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BLOCK = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, np.uint64)
        out[:1] = 1
        return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, _BLOCK), _powers(_BASE_INVERSE, _BLOCK)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of a sequence from the hash of its start and that of its last word."""
    with np.errstate(over="ignore"):
        return mix(left * np.uint64(0xD6E8FEB86659FD93) + right)


def groups_of_rows(offsets: np.ndarray, most: int = 1 << 20):
    """``(first row, last row + 1)`` of runs of rows with at most ``most`` bytes each, or of single longer rows."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word in order, and the n+1 offsets of the rows into these words.

    A row's end also ends a word. Empty rows have no words. Rows are taken a megabyte at a
    time, so that working arrays stay small.
    """
    hashes, row_at, n = [], [np.zeros(1, np.int64)], 0
    for a, b in groups_of_rows(offsets):
        h, at = _words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashes.append(h)
        row_at.append(at[1:] + n)
        n += len(h)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.concatenate(row_at)


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = word_bounds(data, offsets)
    out = np.zeros(len(starts), np.uint64)
    row_at = np.searchsorted(starts, offsets).astype(np.int64)
    # prefix sums restart at each block's first word, so that powers come from one table
    first = 0
    with np.errstate(over="ignore"):
        while first < len(starts):
            base = starts[first]
            last = max(first + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
            size = int(ends[last - 1] - base)
            up = _UP[:size] if size <= _BLOCK else _powers(_BASE, size)
            down = _DOWN if size <= _BLOCK else _powers(_BASE_INVERSE, size)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(_BYTE[data[base : base + size]] * up, out=sums[1:])
            s, e = starts[first:last] - base, ends[first:last] - base
            out[first:last] = (sums[e] - sums[s]) * down[s]
            first = last
    return mix(out), row_at


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each word and the byte after its last."""
    inside = ~_SPACE[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begins = inside & ~before
    begins[cuts] |= inside[cuts]
    closes = np.zeros(len(data) + 1, bool)
    closes[1:-1] = inside[:-1] & ~inside[1:]
    if len(data):
        closes[-1] = inside[-1]
    closes[cuts] |= inside[cuts - 1]
    return np.flatnonzero(begins), np.flatnonzero(closes)

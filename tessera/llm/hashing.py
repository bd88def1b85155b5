"""Vectorised words, hashes and shingles over the bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def multipliers(n: int, seed: int = 7) -> np.ndarray:
    """n odd 64-bit numbers from a seed."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) + np.uint64(seed)) | np.uint64(1)


@cache
def space_table() -> np.ndarray:
    """Byte to lower-case byte; 0 for the white space 0x20 and 0x09-0x0D. Offset by 1 so that byte 0 is a word byte."""
    t = np.arange(256, dtype=np.uint16) + 1
    t[65:91] += 32
    t[[32, 9, 10, 11, 12, 13]] = 0
    return t


@cache
def letter_table() -> np.ndarray:
    """As space_table, with every ASCII character but letters and digits as a separator."""
    t = space_table().copy()
    for b in range(128):
        if not chr(b).isalnum():
            t[b] = 0
    return t


_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, base & (2**64 - 1), dtype=np.uint64)
        steps[0] = 1
        _powers[base] = have = np.multiply.accumulate(steps)
    return have[:n]


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the bounds of its rows; nulls are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, at, data = col.buffers()
    bounds = np.frombuffer(at, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if data is None or not len(col):
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def chunks(bounds: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes, or a single longer row."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + most, side="right")) - 1)
        yield i, j
        i = j


def runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each run of bytes inside, in order; runs end at the bounds of rows."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    starts[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends)


def run_hashes(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the values from each first to each last place, the same wherever the run lies."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64)
    total = np.cumsum(values.astype(np.uint64) * _power(_BASE, n))
    before = np.where(first > 0, total[first - 1], np.uint64(0))
    return mix((total[last] - before) * _power(_INVERSE, n)[first])


def words(data: np.ndarray, bounds: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the bounds of each row's words."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    b = table[data]
    s, e = runs(b > 0, bounds)
    return run_hashes(b, s, e), np.searchsorted(s, bounds)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's runs of k words, and their bounds; a row with fewer words has its whole sequence as one."""
    m, n = multipliers(k + 1), len(h)
    count = np.diff(at)
    full = np.zeros(n, np.uint64)
    if n >= k:
        acc = h[: n - k + 1] * m[0]
        for j in range(1, k):
            acc += h[j : n - k + 1 + j] * m[j]
        full[: n - k + 1] = mix(acc)
    keep = np.zeros(n, bool)
    if n:
        pos = np.arange(n) - np.repeat(at[:-1], count)
        keep = pos + k <= np.repeat(count, count)
    for i in np.flatnonzero((count > 0) & (count < k)):
        part = h[at[i] : at[i + 1]]
        keep[at[i]] = True
        tail = m[k : k + 1] * np.uint64(len(part))
        full[at[i]] = mix((part * m[: len(part)]).sum(dtype=np.uint64, keepdims=True) + tail)[0]
    got = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    return full[keep], np.concatenate([[0], np.cumsum(got)])

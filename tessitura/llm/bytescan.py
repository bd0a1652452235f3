"""Vectorised scans of UTF-8 text: words, lines and hashes over Arrow buffers, without a Python object per word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240607)
#: Values of bytes and the base of the polynomial hash modulo 2**64; the base is odd and so has an inverse.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
BASE = int(_rng.integers(1, 2**62)) * 8 + 5
INVERSE = pow(BASE, -1, 2**64)
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[65:91] += 32
SLICE = 1 << 17
_powers: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    if base in _powers and len(_powers[base]) >= n:
        return _powers[base][:n]
    p = np.full(max(n, SLICE + 1), base & (2**64 - 1), dtype=np.uint64)
    p[0] = 1
    with np.errstate(over="ignore"):
        np.cumprod(p, out=p)
    if n <= SLICE + 1:  # those of a longer text are made for it alone
        _powers[base] = p
    return p[:n]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base, or of its inverse."""
    return _pow(INVERSE if inverse else BASE, n)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U(33))


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past the last row, bytes, offsets from 0) for runs of rows of about `most` bytes; null counts as empty.

    A longer text makes a slice of its own, whole.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    release()


#: Arrow's buffers come from malloc too, so that one call gives back all that is free.
pa.set_memory_pool(pa.system_memory_pool())
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back: Spark keeps idle workers, and several of them share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


class Words:
    """The words of a slice: starts, ends, and for each text the range of its words in `first`."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        self.data, self.offsets = data, offsets
        w = IS_WORD[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, w[:-1]
            after[-1], after[:-1] = False, w[1:]
        self.starts = np.flatnonzero(w & (~before | edge[:-1]))
        self.ends = np.flatnonzero(w & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        return ranges(self.data, self.starts, self.ends)


def ranges(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges."""
    n = len(data)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUE[data] * _pow(BASE, n), out=total[1:])
        return mix((total[ends] - total[starts]) * _pow(INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


def shingles(words: Words, k: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles and their texts' numbers, in order of place. Texts of fewer than k words have none."""
    h = words.hashes() if hashes is None else hashes
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = words.doc()
    with np.errstate(over="ignore"):
        s = h[:n].copy()
        for i in range(1, k):
            s = s * U(0x9E3779B97F4A7C15 + 2 * i) + h[i : i + n]
    inside = doc[:n] == doc[k - 1 :]
    return mix(s[inside]), doc[:n][inside]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values over consecutive ranges; empty ranges give 0."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]

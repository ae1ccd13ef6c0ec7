"""Texts of an Arrow batch as one byte buffer, cut into words by numpy.

Everything here works on a bounded piece of a batch (:func:`pieces`), with
whole texts; no per-character Python.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer single text is a piece of its own.
PIECE_BYTES = 2 << 20
#: Odd multiplier of the polynomial word hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of BASE and INVERSE (grown as needed, shared by pieces)."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        made = []
        for b in (BASE, INVERSE):
            t = np.full(size, b, np.uint64)
            t[0] = 1
            made.append(np.cumprod(t, dtype=np.uint64))
        _powers = tuple(made)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts of the rows' texts plus the end) of
    consecutive rows with at most ``limit`` bytes (or one longer text). Null
    texts are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset: column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, raw[off[lo]: off[hi]], off[lo: hi + 1] - off[lo]
        lo = hi


def runs(inside: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of True that stays in its row."""
    n = len(inside)
    if n == 0:
        z = np.empty(0, np.int64)
        return z, z, z
    first = np.zeros(n, bool)
    edge = starts[:-1]
    first[edge[edge < n]] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    s = np.flatnonzero(inside & (~before | first))
    last = np.zeros(n, bool)
    end = starts[1:] - 1
    last[end[end >= 0]] = True
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    e = np.flatnonzero(inside & (~after | last)) + 1
    return s, e, np.searchsorted(starts, s, side="right") - 1


def hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hash of data[s:e] for each pair; equal bytes, equal hash."""
    up, down = _power_tables(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    return mix((total[e] - total[s]) * down[s])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def lean(run):
    """A batch function that gives free memory back before each new batch and
    when its partition is done: Python workers outlive their tasks, and what their allocators keep
    would add up over the stages of a job."""
    def fed(batches):
        for b in batches:
            yield b
            give_back()

    def wrapped(batches):
        yield from run(fed(batches))
        give_back()
    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, bool)
    for lo, hi in ranges:
        t[lo: hi + 1] = True
    return t


LOWER = lower_table()
#: Digits, letters and every byte of a non-ASCII character.
WORD = byte_set((48, 57), (65, 90), (97, 122), (128, 255))
SPACE = byte_set((9, 13), (32, 32))

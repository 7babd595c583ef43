"""Vectorised text primitives over the UTF-8 buffer of an Arrow string column.

A batch is worked through in chunks of about ``CHUNK`` bytes (a longer document is a
chunk of its own), so that memory follows the longest document, never the batch.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240917))
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BYTE_CODE2 = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 1 << 64))
WBASE = np.uint64(0xD1342543DE82EF95)
WBASE_INV = np.uint64(pow(int(WBASE), -1, 1 << 64))

#: The white space of the contracts, 0x20 and 0x09 to 0x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
NOT_SPACE = ~IS_SPACE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Letters, digits and every byte of a non-ASCII character.
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[48:58] = IS_ALNUM[65:91] = IS_ALNUM[97:123] = IS_ALNUM[128:] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of a base modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.have = base, _powers(base, 1024)

    def __call__(self, n: int) -> np.ndarray:
        if n > len(self.have):
            self.have = _powers(self.base, max(n, 2 * len(self.have)))
        return self.have[:n]


POW, IPOW, WPOW, WIPOW = _Powers(BASE), _Powers(BASE_INV), _Powers(WBASE), _Powers(WBASE_INV)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that the low and high bits are all usable."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, without a copy of the bytes; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)

    def parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        _, off, data = column.buffers()
        offsets = np.frombuffer(off, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets

    raw, offsets = parts(column)
    if column.null_count and np.diff(offsets)[column.is_null().to_numpy(zero_copy_only=False)].any():
        raw, offsets = parts(pc.fill_null(column, ""))
    return raw, offsets


def give_back() -> None:
    """Return freed memory to the machine: workers are reused, and what they keep adds up in an executor."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``kernel``, and what its last variables held is given back as well when a task ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        give_back()

    return run


def chunks(offsets: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``size`` bytes each."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def rows(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of each chunk of a string column."""
    raw, offsets = buffers(column)
    for i, j in chunks(offsets, size):
        yield i, j, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
    give_back()


def words(raw: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each document the range of its words."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = is_word[raw]
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1]
    end[:-1] &= ~w[1:]
    full = off[:-1][off[1:] > off[:-1]]
    start[full] = w[full]
    last = off[1:][off[1:] > off[:-1]] - 1
    end[last] = w[last]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, off)


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, code: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a difference of prefix sums of code[byte] * BASE**position."""
    if not len(s):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(code[raw] * POW(len(raw)), out=total[1:])
    h = (total[e] - total[s]) * IPOW(len(raw))[s]
    return mix(h + (e - s).astype(np.uint64))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` symbols from each position on (``len(h) - k + 1`` of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * WPOW(len(h)), out=total[1:])
    return mix((total[k:] - total[:-k]) * WIPOW(n))


def inside(doff: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of ``n`` window starts keep a window of ``k`` symbols within one document."""
    ok = np.ones(max(n, 0), bool)
    for shift in range(1, k):
        at = doff[1:-1] - shift
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok


def window_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each window of ``w`` neighbours, by doubling."""
    out, have = a, 1
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < w:
        gap = w - have
        out = np.minimum(out[: len(out) - gap], out[gap:])
    return out

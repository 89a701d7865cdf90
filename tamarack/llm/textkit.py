"""Vectorised work on the text buffers of Arrow batches: words, hashes, shingles.

No Python object is made per word.  A block is some documents' UTF-8 bytes in one numpy array.
Lower-casing touches A-Z only and both word classes treat every byte from 0x80 as a word byte,
so working on bytes gives the words that the patterns give on code points.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of ``[^\x20\x09-\x0D]``.
NONSPACE = np.ones(256, bool)
NONSPACE[[9, 10, 11, 12, 13, 32]] = False


def release() -> None:
    """Hands memory that Python, Arrow and the allocator keep for later back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow that hands freed memory back when a task ends: workers live on, and what
    one operator's workers keep is missing to the next one's."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def randoms(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit values that follow from the seed."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 32)) * np.uint64(0x9E3779B97F4A7C15))


_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE = randoms(256, 7)
_POW: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    if len(_POW[0]) < n:
        n = max(n, BLOCK_BYTES + (1 << 16))
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POW[k] = np.cumprod(p)
    return _POW[0], _POW[1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Sums whose differences, times an inverse power, are hashes of the bytes between."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inv = powers(len(prefix))[1]
    return mix((prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offs


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0); a row is never split."""
    raw, offs = text_buffers(column)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of each document, and each document's first word's index."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = inside[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    start = w.copy()
    start[1:] &= ~w[:-1] | first[1:n]
    end = w.copy()
    end[:-1] &= ~w[1:] | first[1:n]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(data: np.ndarray, offs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts, ends, hashes, and the index of each document's first word."""
    low = LOWER[data]
    starts, ends, at = word_spans(low, offs, inside)
    return low, starts, ends, span_hash(prefix_hash(low), starts, ends), at


_STEP = randoms(64, 11) | np.uint64(1)


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, from each word on; the last k-1 entries cross the end."""
    out = np.zeros(len(h), np.uint64)
    for j in range(min(k, len(h))):
        out[: len(h) - j] += h[j:] * _STEP[j]
    return mix(out + np.uint64(k))


def hash_words(parts: list[bytes]) -> np.ndarray:
    """The hashes that ``words`` gives for these words."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64) if parts else np.zeros(0, np.int64)
    return span_hash(prefix_hash(data), ends - np.array([len(p) for p in parts], np.int64), ends)


def owner(at: np.ndarray, n: int) -> np.ndarray:
    """Which document each of n words belongs to; at: first word of each document, and the end."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))

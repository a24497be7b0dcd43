"""Vectorised word and shingle hashing over Arrow text columns.

The kernels look at the UTF-8 buffer of an Arrow string column, so no Python
string is made for a word. Work is cut into slices of about ``SLICE_BYTES`` of
text: temporary arrays are bounded by the slice, or by the longest single text.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. All of those are
ASCII, so splitting bytes and splitting code points give the same words. A null
text is treated as an empty one everywhere.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 1 << 20
SLICE_ROWS = 1 << 15
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_SEED = 0x1F83D9ABFB41BD6B

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def release() -> None:
    """Give freed memory back to the system. Python workers are reused, so what one stage leaves behind would add to the next one's need."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same Arrow function, which releases memory when its task ends."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return outer


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply, shift), applied elementwise."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Words up to so many bytes are hashed together, eight bytes at a time; longer ones one by one.
_TOGETHER = 64


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if large else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose text is at most ``limit`` bytes, or one longer text."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(n, max(hi, lo + 1), lo + SLICE_ROWS)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words, and the first word's number of each text (len + 1)."""
    if len(data) == 0:
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes; ``lower`` maps A-Z to a-z first.

    Every eight bytes are mixed into the state by a non-linear bijection, so no family of words collides by construction.
    """
    out = np.empty(len(starts), dtype=_U)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + SLICE_BYTES, side="right")))
        part = data[base : int(ends[j - 1])]
        if lower:
            part = _LOWER[part]
        s, size = starts[i:j] - base, ends[i:j] - starts[i:j]
        padded = np.concatenate([part, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(part) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        state = mix64(size.astype(_U) * _U(0xA0761D6478BD642F) + _U(_SEED))
        live = np.flatnonzero((size > 0) & (size <= _TOGETHER))
        at = 0
        while len(live):
            left = np.minimum(size[live] - at, 8).astype(_U)
            taken = eight[s[live] + at] & (_U(_MASK) >> (_U(64) - _U(8) * left))
            state[live] = mix64((state[live] ^ taken) * _U(_BASE) + _U(at))
            at += 8
            live = live[size[live] > at]
        raw = None
        for w in np.flatnonzero(size > _TOGETHER).tolist():
            raw = part.tobytes() if raw is None else raw
            state[w] = xxhash.xxh3_64_intdigest(raw[s[w] : s[w] + size[w]], _SEED)
        out[i:j] = state
        i = j
    return out


def shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words inside one text, and the first run's number of each text.

    A text with fewer words (but at least one) has its whole sequence as its one run.
    """
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(count)])
    total = int(begin[-1])
    if total == 0:
        return np.zeros(0, _U), begin
    at = np.arange(total) - np.repeat(begin[:-1], count) + np.repeat(first[:-1], count)
    end = np.repeat(first[1:], count)
    acc = np.zeros(total, dtype=_U)
    padded = np.concatenate([hashes, np.zeros(k, _U)])
    factor = 1
    for j in range(k):
        factor = factor * 0xD6E8FEB86659FD93 & _MASK
        acc += np.where(at + j < end, padded[at + j] * _U(factor), _U(0))
    return mix64(acc), begin


def distinct_sorted(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text in ascending order, and where each text's run begins."""
    owner = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    keep = np.ones(len(v), dtype=bool)
    keep[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[keep], o[keep]
    return v, np.searchsorted(o, np.arange(len(begin)))

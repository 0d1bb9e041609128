"""Vectorised word kernels over Arrow string buffers.

A word is a maximal run of bytes other than space and \\x09-\\x0D, which in UTF-8 is the
same as a maximal run of such characters. Words are identified by 64-bit polynomial hashes
with a final mix; work is cut into byte segments so that memory follows the number of words
and the longest word, never the longest text times eight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEGMENT = 1 << 20
_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _geometric(ratio: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    have = 1
    while have < n:
        step = min(have, n - have)
        out[have : have + step] = out[:step] * _U(pow(ratio, have, 1 << 64))
        have += step
    return out


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_SEGMENT, n) + 1
    if not _powers or next(iter(_powers)) < size:
        _powers.clear()
        _powers[size] = _geometric(_BASE, size), _geometric(pow(_BASE, -1, 1 << 64), size)
    return next(iter(_powers.values()))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def string_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_bounds(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, for each text, the index of its first word (one more entry than texts)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~space[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offs[(offs > 0) & (offs < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    out = np.empty(len(starts), _U)
    i = 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + _SEGMENT, "right")))
        to = int(ends[j - 1])
        part = buf[at:to]
        power, inverse = _pow(to - at)
        if lower:
            part = _LOWER[part]
        total = np.zeros(to - at + 1, _U)
        np.cumsum((part.astype(_U) + _U(1)) * power[: to - at], out=total[1:])
        s, e = starts[i:j] - at, ends[i:j] - at
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
        i = j
    return out


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; entry i starts at word i."""
    if len(words) < n:
        return np.zeros(0, _U)
    total = np.zeros(len(words) - n + 1, _U)
    for k in range(n):
        total = total * _U(0xC2B2AE3D27D4EB4F) + words[k : k + len(total)]
        total ^= total >> _U(29)
    return mix(total)


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct n-word shingles of one text; fewer words make one shingle, none make none."""
    if not len(words):
        return np.zeros(0, _U)
    if len(words) < n:
        return window_hashes(words, len(words)) ^ _U(len(words))
    return np.unique(window_hashes(words, n))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20):
    """Cut a batch into runs of rows with about ``limit`` bytes of text (one row at least)."""
    if not batch.num_rows:
        return
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths.astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(total[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to

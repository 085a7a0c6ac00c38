"""Vectorised text kernels over Arrow string columns.

A word is a maximal run of bytes outside ASCII white space (space and \\x09-\\x0D), with A-Z lowered.
Words and word windows are identified by 64-bit hashes computed with array operations; no Python
object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes worked on at once; a longer document is a chunk of its own.
CHUNK = 1 << 20

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_SHINGLE = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_LOWER += np.uint64(1)

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK) + 1
        _powers[:] = []
        for base in (_B, _B_INV):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.cumprod(p))
    return _powers[0], _powers[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply rounds)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and per-row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offsets


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK bytes each."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the rows, and where each row's words begin (len(rows) + 1 entries)."""
    base, end = int(offsets[0]), int(offsets[-1])
    b = data[base:end]
    rel = offsets - base
    n = len(b)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(rel), np.int64)
    fwd, inv = _power_tables(n + 1)
    solid = ~_SPACE[b]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(solid[:-1], out=first[1:])
    starts_of_rows = rel[:-1][rel[:-1] < n]
    first[starts_of_rows] = True
    first &= solid
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(solid[1:], out=last[:-1])
    ends_of_rows = rel[1:][rel[1:] > 0] - 1
    last[ends_of_rows] = True
    last &= solid
    s, e = np.flatnonzero(first), np.flatnonzero(last)
    value = _LOWER[b] * fwd[:n]
    total = np.cumsum(value, dtype=np.uint64)
    h = (total[e] - total[s] + value[s]) * inv[s]
    return mix64(h), np.searchsorted(s, rel)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its word windows.

    A row with fewer than `width` words has one window, its whole sequence; a row without words has none.
    """
    keys = _SHINGLE[:width]
    while len(keys) < width:
        keys = [*keys, keys[-1] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2)]
    if len(words) >= width:
        acc = np.zeros(len(words) - width + 1, np.uint64)
        for k in range(width):
            acc += words[k : len(words) - width + 1 + k] * keys[k]
        acc = mix64(acc)
    else:
        acc = np.empty(0, np.uint64)
    bounds = rows.tolist()
    for a, z in zip(bounds, bounds[1:]):
        if z - a >= width:
            x = np.sort(acc[a : z - width + 1])
            yield x if len(x) < 2 else x[np.concatenate(([True], x[1:] != x[:-1]))]
        elif z > a:
            short = (words[a:z] * np.array(keys[: z - a], np.uint64)).sum(keepdims=True) + np.uint64(z - a)
            yield mix64(short ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        else:
            yield np.empty(0, np.uint64)

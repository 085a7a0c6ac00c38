"""Words of string columns under any division into bytes: 64-bit names, and where the words lie.

Texts are worked through in stretches of about CHUNK bytes that end between words, so memory does not
grow with the length of a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from ._text import _LOWER, CHUNK, _power_tables, mix64


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, set for the bytes of the ranges (both ends included)."""
    out = np.zeros(256, bool)
    for a, z in ranges:
        out[a : z + 1] = True
    return out


def stretches(raw: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about CHUNK bytes over all rows, none ending inside a word."""
    at, end = int(offsets[0]), int(offsets[-1])
    while at < end:
        to = min(end, at + CHUNK)
        if to < end:
            edge = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            loose = np.flatnonzero(~solid[raw[max(at, edge) : to]])
            if len(loose):
                to = max(at, edge) + int(loose[-1]) + 1
            elif edge > at:
                to = edge
            else:  # one word longer than a stretch
                limit = int(offsets[np.searchsorted(offsets, to, "right")])
                while to < limit and solid[raw[to]]:
                    to += 1
        yield at, to
        at = to


def spans(raw: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Names, first bytes and ends of the words, stretch by stretch. A word is a maximal run of solid bytes within a row;
    words that differ only in the case of A-Z have one name."""
    for a, z in stretches(raw, offsets, solid):
        b = raw[a:z]
        n = len(b)
        hard = solid[b]
        first = np.append(True, ~hard[:-1])
        last = np.append(~hard[1:], True)
        inner = offsets[np.searchsorted(offsets, a) : np.searchsorted(offsets, z, "right")] - a
        first[inner[inner < n]] = True
        last[inner[inner > 0] - 1] = True
        s, e = np.flatnonzero(first & hard), np.flatnonzero(last & hard)
        forward, inverse = _power_tables(n + 1)
        value = _LOWER[b] * forward[:n]
        total = np.cumsum(value, dtype=np.uint64)
        yield mix64((total[e] - total[s] + value[s]) * inverse[s]), s + a, e + (a + 1)

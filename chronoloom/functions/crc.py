"""CRC-32C for byte arrays, by many lanes at once.

The checksum is linear over GF(2): a message is cut into equal lanes (leading zeros change nothing when
the register starts at zero), all lanes advance together through one table, and neighbouring lanes
combine in a tree by the operator that appends so many zero bytes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import LongType

# Fixed value: the Castagnoli polynomial, reflected.
POLYNOMIAL = 0x82F63B78
_ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1).astype(np.uint32)
    return t


_BYTE = _byte_table()


#: The same for two bytes at once.
_PAIR = _BYTE[np.arange(65536) & 0xFF]
_PAIR = _BYTE[(_PAIR ^ (np.arange(65536, dtype=np.uint32) >> np.uint32(8))) & 0xFF] ^ (_PAIR >> np.uint32(8))


def _advance(state: np.ndarray) -> np.ndarray:
    """One zero byte appended."""
    return _BYTE[state & 0xFF] ^ (state >> np.uint32(8))


def _apply(columns: np.ndarray, state: np.ndarray) -> np.ndarray:
    """A 32x32 bit matrix (its columns) times each state, by four byte tables."""
    out = np.zeros_like(state)
    for k, t in enumerate(_tables(columns.tobytes())):
        out ^= t[(state >> np.uint32(8 * k)) & 0xFF]
    return out


@lru_cache(maxsize=64)
def _tables(columns: bytes) -> tuple[np.ndarray, ...]:
    col = np.frombuffer(columns, np.uint32)
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return tuple(np.bitwise_xor.reduce(np.where(bits, col[8 * k : 8 * k + 8], 0).astype(np.uint32), axis=1) for k in range(4))


@lru_cache(maxsize=256)
def _zeros(n: int) -> bytes:
    """The operator that appends n zero bytes, as 32 columns."""
    unit = np.uint32(1) << np.arange(32, dtype=np.uint32)
    out, step = unit, _advance(unit)
    while n:
        if n & 1:
            out = _apply(step, out)
        step = _apply(step, step)
        n >>= 1
    return out.tobytes()


def crc32c(data: bytes | memoryview | np.ndarray) -> int:
    b = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
    n = len(b)
    lanes = 1
    while lanes < 4096 and n // (2 * lanes) >= 64:
        lanes *= 2
    width = -(-n // lanes)
    width += width & 1
    padded = np.zeros(lanes * width, np.uint8)
    if n:
        padded[-n:] = b
    column = np.ascontiguousarray(padded.view("<u2").reshape(lanes, width // 2).T).astype(np.uint32)
    state = np.zeros(lanes, np.uint32)
    for row in column:
        row ^= state
        row &= 0xFFFF
        state >>= np.uint32(16)
        state ^= _PAIR.take(row)
    while len(state) > 1:
        op = np.frombuffer(_zeros(width), np.uint32)
        state = _apply(op, state[0::2]) ^ state[1::2]
        width *= 2
    first = _apply(np.frombuffer(_zeros(n), np.uint32), np.array([_ALL]))
    return int(state[0] ^ first[0] ^ _ALL)


def crc32c_rows(rows: np.ndarray) -> np.ndarray:
    """The checksum of every row of a uint8 matrix: all rows advance together, byte by byte."""
    state = np.full(len(rows), _ALL)
    for column in np.ascontiguousarray(rows.T):
        state = _BYTE[(state ^ column) & 0xFF] ^ (state >> np.uint32(8))
    return state ^ _ALL


def crc32c_many(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The checksum of every slice offsets[i]:offsets[i + 1]; slices of like length go through the table together.

    Short slices are padded in front: leading zeros change nothing while the register is zero, so the rows
    start at zero with their first four bytes inverted, which is what the initial register does; to shorter slices the
    register, advanced by their length, is added at the end.
    """
    n = np.diff(offsets)
    out = np.zeros(len(n), np.int64)
    long_ = np.flatnonzero(n > 8192)
    for i in long_.tolist():
        out[i] = crc32c(data[offsets[i] : offsets[i + 1]])
    rest = np.setdiff1d(np.arange(len(n)), long_, assume_unique=True)
    rest = rest[np.argsort(n[rest], kind="stable")]
    for a in range(0, len(rest), 1024):
        own = rest[a : a + 1024]
        width = int(n[own].max())
        width += width & 1
        at = offsets[own + 1][:, None] + np.arange(-width, 0)
        rows = np.where(at >= offsets[own][:, None], data[np.maximum(at, 0)] if len(data) else 0, 0).astype(np.uint8)
        size = n[own]
        whole = np.flatnonzero(size >= 4)
        rows[whole[:, None], (width - size[whole])[:, None] + np.arange(4)] ^= np.uint8(0xFF)
        state = np.zeros(len(own), np.uint32)
        for pair in np.ascontiguousarray(rows.view("<u2").T):
            state = _PAIR.take((state ^ pair) & 0xFFFF) ^ (state >> np.uint32(16))
        for k in range(4):
            state[size == k] ^= _apply(np.frombuffer(_zeros(k), np.uint32), np.array([_ALL]))[0]
        out[own] = state ^ _ALL
    return out


@arrow_udf(LongType())
def crc32c_udf(data: pa.Array) -> pa.Array:
    """CRC-32C of a BINARY column; null stays null."""
    if isinstance(data, pa.ChunkedArray):
        data = data.combine_chunks()
    whole = data.cast(pa.large_binary())
    if not len(whole):
        return pa.array([], pa.int64())
    _, off, raw = whole.buffers()
    offsets = np.frombuffer(off, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    values = crc32c_many(np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8), offsets)
    return pa.array(values, pa.int64(), mask=whole.is_null().to_numpy(zero_copy_only=False))

"""Vectorised tokenisation and hashing over Arrow string buffers.

Everything works on the UTF-8 bytes of a whole Arrow batch at once; nothing
loops over documents.  Words are maximal runs of bytes outside 0x20 and
0x09-0x0D, which never split a UTF-8 sequence.  Null texts count as empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 19
_POW = np.multiply.accumulate(np.full(_CHUNK, _BASE, dtype=np.uint64))
_INV = np.multiply.accumulate(np.full(_CHUNK, pow(_BASE, -1, 1 << 64), dtype=np.uint64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (in a new array)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document and the total) as byte positions."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[data]
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    stop = solid.copy()
    stop[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    begin[inner] = solid[inner]
    stop[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(stop) + 1, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of data[start:end] for ascending, disjoint spans; lower folds A-Z."""
    out = np.empty(len(starts), np.uint64)
    table, at = (_BYTE_LOWER if lower else _BYTE), 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
        if ends[at] - base > _CHUNK:  # one huge span: fold it chunk by chunk
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for p in range(int(base), int(ends[at]), _CHUNK):
                    part = table[data[p : min(p + _CHUNK, int(ends[at]))]]
                    h = mix64(np.array([h + (part * _POW[: len(part)]).sum(dtype=np.uint64)]))[0]
            out[at] = h
            at += 1
            continue
        seen = table[data[base : ends[to - 1]]]
        seen *= _POW[: len(seen)]
        total = np.zeros(len(seen) + 1, np.uint64)
        np.cumsum(seen, out=total[1:])
        s = starts[at:to] - base
        out[at:to] = (total[ends[at:to] - base] - total[s]) * _INV[s]
        at = to
    return mix64(out)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive hashes (len(h) - k + 1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(0xD1342543DE82EF95)
        out += h[j : j + n]
    return mix64(out)


def owner(first: np.ndarray) -> np.ndarray:
    """The document of each word, from words()'s third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    n, span = len(x) - w + 1, 1
    if n <= 0:
        return x[:0]
    m = x
    while span * 2 <= w:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    return m[:n] if span == w else np.minimum(m[:n], m[w - span : w - span + n])

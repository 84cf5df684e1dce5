"""Vectorised text primitives shared by the operators of this package.

Texts are handled as the UTF-8 bytes that Arrow holds, without a Python object for each word.
Words are hashed with a polynomial modulo 2**64 over their bytes, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
CHUNK = 1 << 20  # bytes of text handled at once

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_pow = _inv = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if _pow is None or len(_pow) < n:
        n = max(n, CHUNK + 1)
        one = np.ones(1, U)
        with np.errstate(over="ignore"):
            _pow = np.concatenate([one, np.cumprod(np.full(n - 1, _BASE, U))])
            _inv = np.concatenate([one, np.cumprod(np.full(n - 1, pow(_BASE, -1, 1 << 64), U))])
    return _pow, _inv


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective finaliser of 64 bits."""
    with np.errstate(over="ignore"):
        x = x + U((salt * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


def pieces(off: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each; a longer text stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def words(raw: np.ndarray, off: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes that are not `apart`; runs never cross rows.

    raw: the bytes of the rows alone; off: offsets into it, the first of them 0.
    """
    n = len(raw)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    isw = ~apart[raw]
    cut = np.zeros(n + 1, bool)
    cut[off[off <= n]] = True
    start = isw.copy()
    start[1:] &= ~isw[:-1] | cut[1:n]
    end = isw.copy()
    end[:-1] &= ~isw[1:] | cut[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(off, s, "right") - 1


def hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of raw[s:e] for each word."""
    if not len(s):
        return np.zeros(0, U)
    p, q = _powers(len(raw) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(raw) + 1, U)
        np.cumsum((raw.astype(U) + U(1)) * p[: len(raw)], out=total[1:])
        return mix(((total[e] - total[s]) * q[s]) ^ ((e - s).astype(U) << U(56)), salt)


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return LOWER[raw]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def binary_column(parts: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column of the rows' values of `parts`, counts[i] of them each."""
    size = parts.dtype.itemsize
    off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64) * size
    if off[-1] > 2**31 - 1:
        raise ValueError("a binary column above 2 GB")
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(off.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(parts).tobytes())])

"""Texts of an Arrow batch as one flat byte array, for vectorised kernels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Fixed odd multipliers of a 64-bit finaliser (public-domain mixing constants).
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _S)
    x = x * _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


#: A random 64-bit word for each byte value, from a rule.
BYTE_WORDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null counts as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null(b"" if "binary" in str(column.type) else "")
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets): whole texts, about ``limit`` bytes together."""
    data, off = buffers(column)
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b, data[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _TABLES:
        _TABLES.clear()
        _TABLES[size] = (_powers(size, _BASE), _powers(size, _INVERSE))
    return _TABLES[size]


def ranges_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray = BYTE_WORDS) -> np.ndarray:
    """A 64-bit hash of each byte range: a polynomial over random words of the bytes, from
    prefix sums, finalised together with the length."""
    power, inverse = _tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(words[data] * power[: len(data)], out=sums[1:])
    value = (sums[ends] - sums[starts]) * inverse[starts]
    return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def spans(keep: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of true in ``keep`` that stay within a text: (starts, ends, text index)."""
    n = len(keep)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    first = np.zeros(n + 1, bool)
    first[off[:-1]] = True
    first = first[:n]
    prev = np.empty(n, bool)
    prev[0] = False
    prev[1:] = keep[:-1]
    starts = np.flatnonzero(keep & (~prev | first))
    nxt = np.empty(n, bool)
    nxt[-1] = False
    nxt[:-1] = keep[1:]
    last = np.zeros(n, bool)
    inner = off[1:-1]
    last[inner[inner > 0] - 1] = True
    ends = np.flatnonzero(keep & (~nxt | last)) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1

"""Whole-batch text primitives on numpy: tokens, 64-bit word hashes and set helpers.

Every function works on the UTF-8 bytes of many texts at once; nothing loops over rows.
Word hashes are polynomial prefix sums (mod 2**64) followed by a bijective finaliser, so two
different words share a hash with probability about 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of text handled at once; an 8-byte array over it stays at 8 times this size.
CHUNK = 1 << 21

_BASE = 0x9E3779B97F4A7C15 | 1
_pow: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        size = max(n, CHUNK + 1)
        p, q = np.full(size, _BASE, U), np.full(size, pow(_BASE, -1, 1 << 64), U)
        p[0] = q[0] = 1
        _pow["p"], _pow["q"] = np.cumprod(p), np.cumprod(q)
    return _pow["p"], _pow["q"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _table(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: White space of ASCII separates tokens.
SPACE = _table(lambda b: b in b" \t\n\r\v\f")
TOKEN = ~SPACE
#: Letters, digits and every byte of a non-ASCII character.
ALNUM = _table(lambda b: b >= 128 or chr(b).isalnum())


def column(batch: pa.RecordBatch, name: str | int = 0) -> pa.Array:
    """A string column with nulls made empty, in one chunk."""
    col = batch.column(name)
    if pa.types.is_binary(col.type):
        col = col.view(pa.string())
    return pc.fill_null(col, "") if col.null_count else col


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array, and where each value starts (one more at the end)."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    buffers = col.buffers()
    offs = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    if not len(offs):
        offs = np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offs[0] : offs[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def pieces(col: pa.Array, lower: bool = False, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row past the last, bytes, offsets); at most ``size`` bytes or one row."""
    if lower:
        col = pc.utf8_lower(col)
    _, offs = raw(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        data, o = raw(col.slice(i, j - i))
        yield i, j, data, o
        i = j


def runs(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in ``table`` within each value, and the
    number of runs that lie before each value (as offsets)."""
    n = len(data)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = table[data]
    first = np.zeros(n + 1, bool)
    first[offs[:-1]] = True
    first[n] = True
    starts = np.flatnonzero((inside[1:-1] == 1) & ((inside[:-2] == 0) | first[:-1]))
    ends = np.flatnonzero((inside[1:-1] == 1) & ((inside[2:] == 0) | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end]."""
    n = len(data)
    p, q = _powers(n + 1)
    h = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * p[:n], out=h[1:])
    w = (h[ends] - h[starts]) * q[starts]
    return mix(w + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93) + U(salt))


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray = ALNUM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, word offsets of each value)."""
    s, e, wo = runs(data, offs, table)
    return hashes(data, s, e), s, e, wo


def owners(wo: np.ndarray) -> np.ndarray:
    """For offsets, the index of the value that owns each element."""
    return np.repeat(np.arange(len(wo) - 1), np.diff(wo))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes; the last k-1 entries are missing."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    s = h[:n].copy()
    for i in range(1, k):
        s = s * U(0x9FB21C651E98DF25) + h[i : i + n]
    return mix(s)


def within(wo: np.ndarray, k: int) -> np.ndarray:
    """True where k words from here on belong to the same value; as long as shingles(h, k)."""
    n = int(wo[-1]) - k + 1
    if n <= 0:
        return np.zeros(0, bool)
    end = np.repeat(wo[1:], np.diff(wo))[:n]
    return np.arange(n) + k <= end


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start+1, ... (count of them) for each start, in one array."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = counts > 0
    s, c = starts[keep], counts[keep]
    at = np.cumsum(c)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - s[:-1] - c[:-1] + 1
    return np.cumsum(out)

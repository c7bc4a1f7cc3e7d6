"""Numpy helpers on whole Arrow batches of texts: bytes, words, rolling hashes.

All hashes are 64 bits and fixed, so equal words hash alike in every task and job.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so its powers have inverses modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
CHUNK = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2**64."""
    if base not in _powers or len(_powers[base]) < n:
        size = max(n, CHUNK)
        out = np.full(size, U(base))
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective finish that spreads every bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column, null as empty, and the n + 1 offsets of its rows."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, at, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(at, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0]:offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task holds the Python values of few rows at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def release() -> None:
    """Give freed memory back to the system, where the C library can: Python workers stay for later stages and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def ddl(df, names) -> list[str]:
    """Schema of the named columns, in this order, for the Arrow functions."""
    return [f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names]


def runs_of_rows(offs: np.ndarray, size: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Consecutive rows [i, j) of at most ``size`` bytes together; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_sums(b: np.ndarray, base: int = BASE) -> np.ndarray:
    """Sums that give the hash of any byte range by ``range_hash``."""
    out = np.zeros(len(b) + 1, U)
    np.cumsum((b.astype(U) + U(1)) * powers(base, len(b)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: int = INVERSE) -> np.ndarray:
    """Hash of the bytes [start, end), independent of where they stand."""
    return (sums[end] - sums[start]) * powers(inverse, len(sums))[start]


def words(b: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of bytes other than ASCII white space) of all rows."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    is_word = ~SPACE[b]
    first = np.zeros(len(b) + 1, bool)
    first[offs] = True
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1] | first[1:-1]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | first[1:-1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(col) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per run of rows [i, j): hashes of the words of the A-Z lower-cased texts, and the first
    word of each row (j - i + 1 offsets into the hashes)."""
    buf, offs = text_bytes(col)
    for i, j in runs_of_rows(offs):
        b = LOWER[buf[offs[i]:offs[j]]]
        at = offs[i:j + 1] - offs[i]
        s, e = words(b, at)
        h = mixed(range_hash(prefix_sums(b), s, e) + (e - s).astype(U)) if len(s) else np.zeros(0, U)
        yield i, j, h, np.searchsorted(s, at)


def shingles(h: np.ndarray, first: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of k consecutive words of each row, sorted within the row, with the
    n + 1 offsets of the rows. A row of 1 to k - 1 words has one shingle, all its words."""
    n = np.diff(first)
    rows = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - first[:-1][rows]
    width = np.minimum(k, n[rows])
    take = place + width <= n[rows]
    at = np.flatnonzero(take)
    out = np.zeros(len(at), U)
    w = width[at]
    for d in range(k):
        ok = d < w
        out[ok] = out[ok] * U(0x100000001B3) + h[at[ok] + d]
    out = mixed(out + w.astype(U))
    row = rows[at]
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    if len(out):
        keep = np.ones(len(out), bool)
        keep[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
        out, row = out[keep], row[keep]
    return out, np.searchsorted(row, np.arange(len(n) + 1))

"""Periodic runs of words by string synchronising sets.

A run is a stretch of words with smallest period q and at least 4 q words that no neighbour extends. Periods below 4 are detected by
themselves: words q apart are compared over the whole text. For each dyadic scale t from 4 on, hash-selected places propose the periods
from t to 2 t - 1. A place is selected when the smallest hash among the windows of t words that start up to t words after it is its own
or the one t words on. That depends on the 2 t words from the place only, so equal contexts are selected alike; windows inside the
regions already known with a period of at most t / 4 have no hash, which keeps those regions from filling the set. Every run with a period
of the scale holds a selected place among its first t, and the next place with the same context stands one period after it. So only
neighbours in the order of (context, place) propose, and what they propose is extended both ways.

Words are numbered exactly, and a run is stated only after its words were compared. A collision of 64-bit hashes of different contexts
could hide a run; it cannot invent one.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.textnum import BASE, INVERSE, U, ddl, mixed, powers, slices

TIMES, LEAST = 4, 6  # a run has at least TIMES periods and LEAST words
SMALL = 4  # periods below are found by comparing the whole text with itself; the first scale
WORDS = 1 << 18  # words that are worked on together; a longer text stands alone
NONE = np.iinfo(np.uint64).max


def sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours: running minima of blocks from both sides."""
    n = len(x) - w + 1
    blocks = np.concatenate([x, np.full(-len(x) % w, NONE, U)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, 1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True."""
    edge = np.diff(np.concatenate([[0], same.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Hashes:
    """Hashes of the stretches of a sequence of numbers."""

    def __init__(self, x: np.ndarray):
        self.sums = np.zeros(len(x) + 1, U)
        np.cumsum(mixed(x.astype(U) + U(BASE)) * powers(BASE, len(x)), out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * powers(INVERSE, len(self.sums))[start])


def reach(hashes: Hashes, a: np.ndarray, b: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """How many words are equal onwards from the places a and b (or before them), ``most`` at most."""
    low, high = np.zeros(len(a), np.int64), most.copy()
    while (low < high).any():
        mid = (low + high + 1) // 2
        same = hashes(a - mid, a) == hashes(b - mid, b) if back else hashes(a, a + mid) == hashes(b, b + mid)
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def _exact(x: np.ndarray, start: int, end: int, q: int, at: int) -> tuple[int, int]:
    """The stretch around ``at`` in which words q apart are the same; [start, end) is what hashes say."""
    if (x[start:end - q] == x[start + q:end]).all():
        return start, end
    other = np.flatnonzero(x[:-q] != x[q:])
    k = int(np.searchsorted(other, at))
    return (int(other[k - 1]) + 1 if k else 0), (int(other[k]) if k < len(other) else len(x) - q) + q


def proposed(x: np.ndarray, scale: int, dull: np.ndarray) -> tuple[np.ndarray, np.ndarray, Hashes]:
    """Places and the periods, of this scale, that equal contexts propose. ``dull``: windows of ``scale`` words of small period."""
    n = len(x) - scale + 1
    hashes = Hashes(x)
    at = np.arange(n)
    own = hashes(at, at + scale)
    own[dull[:n]] = NONE
    least = sliding_least(own, scale + 1)
    m = len(least)
    s = np.flatnonzero(((least == own[:m]) | (least == own[scale:scale + m])) & (least != NONE))
    context = hashes(s, s + 2 * scale)
    by = np.argsort(context, kind="stable")
    context, s = context[by], s[by]
    gap = s[1:] - s[:-1]
    take = (context[1:] == context[:-1]) & (gap >= scale) & (gap < 2 * scale)
    return s[:-1][take], gap[take], hashes


def runs_of(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, length and period of the runs of several rows, sorted by (row, start, period).

    ``x`` has the word numbers of all rows, each row followed by a number of its own; ``sizes`` the words of each row.
    """
    first = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # start and end in x, period; all with TIMES periods
    for q in range(1, SMALL):
        start, end = stretches(x[q:] == x[:-q]) if len(x) > q else (np.zeros(0, np.int64),) * 2
        ok = end - start + q >= TIMES * q
        found.append((start[ok], end[ok] + q, np.full(int(ok.sum()), q)))
    scale, y, place = SMALL, x, np.arange(len(x))
    while (large := sizes >= TIMES * scale).any():
        keep = np.repeat(large, sizes + 1)[place]
        y, place = y[keep], place[keep]
        dull = np.zeros(len(y) + 1, np.int64)
        for start, end, q in found:
            ok = (q * TIMES <= scale) & (end - start >= scale)
            a = np.searchsorted(place, start[ok])
            ok_row = (a < len(place)) & (place[np.minimum(a, len(place) - 1)] == start[ok])
            a, b = a[ok_row], a[ok_row] + (end - start)[ok][ok_row] - scale + 1
            np.add.at(dull, a, 1)
            np.add.at(dull, b, -1)
        s, gap, hashes = proposed(y, scale, np.cumsum(dull)[:-1] > 0)
        if len(s):
            start = s - reach(hashes, s, s + gap, s, True)
            end = s + gap + reach(hashes, s, s + gap, len(y) - s - gap, False)
            every = zip(*(v.tolist() for v in _distinct(start, end, gap, s)), strict=True)
            spans = {(*_exact(y, a, b, q, p), q) for a, b, q, p in every}
            spans = sorted(x for x in spans if x[1] - x[0] >= TIMES * x[2])
            if spans:
                a, b, q = (np.array(v, np.int64) for v in zip(*spans, strict=True))
                found.append((place[a], place[b - 1] + 1, q))
        scale *= 2
    start, end, q = (np.concatenate(v) for v in zip(*found, strict=True))
    by = np.lexsort((q, end, start))
    start, end, q = start[by], end[by], q[by]
    ok = end - start >= LEAST
    ok[1:] &= (start[1:] != start[:-1]) | (end[1:] != end[:-1])  # the smallest period of a stretch
    start, end, q = start[ok], end[ok], q[ok]
    row = np.searchsorted(first, start, side="right") - 1
    by = np.lexsort((q, start))
    return row[by], (start - first[row])[by], (end - start)[by], q[by]


def _distinct(start: np.ndarray, end: np.ndarray, q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """One proposal for each (start, end, period)."""
    by = np.lexsort((at, q, end, start))
    start, end, q, at = start[by], end[by], q[by], at[by]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1]) | (q[1:] != q[:-1])
    return start[new], end[new], q[new], at[new]


def planted(words: list[bytes], mark: int | None) -> list[bytes]:
    """The words of a document whose id hashes to ``mark``: for one in ten the tail repeats itself."""
    n = len(words)
    if mark is None or mark % 10 or not n:
        return words
    g = mark // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


SCHEMA = ("n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
          "collapsed_sha256 string, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
_KINDS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _groups(rows: list[list[bytes]]) -> Iterator[tuple[int, int]]:
    """Consecutive rows [i, j) of at most WORDS words; a longer one stands alone."""
    i, n = 0, 0
    for j, w in enumerate(rows):
        if n and n + len(w) > WORDS:
            yield i, j
            i, n = j, 0
        n += len(w)
    if rows:
        yield i, len(rows)


def _found(rows: list[list[bytes]]) -> Iterator[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each row."""
    for i, j in _groups(rows):
        number: dict[bytes, int] = defaultdict(count().__next__)
        sizes = np.array([len(w) for w in rows[i:j]], np.int64)
        parts = [np.fromiter((number[w] for w in r), np.int64, len(r)) for r in rows[i:j]]
        x = np.concatenate([v for k, p in enumerate(parts) for v in (p, [-1 - k])])
        row, start, length, period = runs_of(x, sizes)
        cut = np.searchsorted(row, np.arange(j - i + 1))
        for k in range(j - i):
            part = slice(cut[k], cut[k + 1])
            yield list(zip(start[part].tolist(), length[part].tolist(), period[part].tolist(), strict=True))


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q:s + n] = False
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def with_runs(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), mark: Column | None = None,
              outputs: bool = True) -> DataFrame:
    """``keep`` of every row with its runs, their digests, and the text without what they repeat.

    n_words; n_runs; start, length, period and exponent_milli of the longest run (ties: smallest start, then period; nulls without
    a run); runs_sha256 of all runs as lines ``start,length,period``; collapsed_sha256 of the kept words joined by one space; and with
    ``outputs`` the runs and the collapsed text. Words are what ASCII white space parts, case as it is. Null and empty texts have no
    words and no runs. ``mark`` (long) rewrites the words by ``planted`` first; null leaves them. Repeated rows are answered each.
    Nothing is shuffled; a text is worked on in one task, as a row must be.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    own = docs.select(*(F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True)), F.col(f"`{text}`").alias("text"),
                      (mark if mark is not None else F.lit(None)).cast("long").alias("mark"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            rows = [planted((t or "").encode().split(), m) for t, m in zip(b.column("text").to_pylist(), b.column("mark").to_pylist(), strict=True)]
            out = []
            for words, runs in zip(rows, _found(rows), strict=True):
                s, n, q = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
                left = b" ".join(collapsed_words(words, runs))
                lines = "".join(f"{a},{m},{p}\n" for a, m, p in runs).encode()
                out.append((len(words), len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(lines).hexdigest(),
                            hashlib.sha256(left).hexdigest(), [{"start": a, "length": m, "period": p} for a, m, p in runs] if outputs else None,
                            left.decode() if outputs else None))
            cols = list(zip(*out, strict=True)) or [[]] * 10
            kinds = [pa.int64()] * 6 + [pa.string()] * 2 + [_KINDS, pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             [*names, "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                                              "collapsed_sha256", "runs", "collapsed"])

    done = own.mapInArrow(run, ", ".join([*ddl(own, names), SCHEMA]))
    shown = ["n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", *(["runs", "collapsed"] if outputs else [])]
    return done.select(*(F.col(n).alias(k) for n, k in zip(names, keep, strict=True)), *shown)

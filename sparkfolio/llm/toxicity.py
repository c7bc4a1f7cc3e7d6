"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Texts are lower-cased (A-Z), every byte below 128 that is no letter becomes a blank, and a blank stands at both ends. Features
are the hashed byte n-grams present in a text. Their document counts by class are summed on Spark, give each feature its log ratio
``r``, and a logistic fit finds weights for the scaled features ``r * present``. Fitting uses a bounded sample of labelled rows
(``training.MAX_ROWS``) and keeps the ``MAX_FEATURES`` features that tell most; scores read every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.textnum import U, ddl, slices, runs_of_rows, text_bytes

BITS = 20
SIZES = (4, 5, 6)
MAX_FEATURES = 6_000
SLICES = 16

_FOLD = np.full(256, 32, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def features(col) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per run of rows [i, j): hashed features and their row, one entry for each place in the texts."""
    buf, offs = text_bytes(col)
    for i, j in runs_of_rows(offs):
        n, size = j - i, np.diff(offs[i:j + 1])
        at = np.concatenate([[0], np.cumsum(size + 2)])  # a blank before and after each text
        b = np.full(at[-1], 32, np.uint8)
        rows = np.repeat(np.arange(n), size + 2)
        inside = np.ones(len(b), bool)
        inside[at[:-1]] = inside[at[1:] - 1] = False
        b[inside] = _FOLD[buf[offs[i]:offs[j]]]
        h, r = [], []
        wide = b.astype(U)
        gram = wide.copy()
        for k in range(1, max(SIZES)):
            gram = (gram[:-1] << U(8)) | wide[k:]
            if k + 1 in SIZES:
                ok = rows[:len(gram)] == rows[k:]
                x = (gram + U(k + 1)) * U(0x9E3779B97F4A7C15)
                h.append(((x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93) >> U(64 - BITS))[ok].astype(np.int64))
                r.append(rows[:len(gram)][ok])
        yield i, j, np.concatenate(h), np.concatenate(r)


def present(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, feature) pairs."""
    key = np.unique(row.astype(np.int64) << BITS | h)
    return key & ((1 << BITS) - 1), key >> BITS


class NgramModel:
    """Weight of each kept feature, by place in a table of 2 ** BITS."""

    def __init__(self, kept: np.ndarray, weights: np.ndarray, base: float):
        self.kept, self.weights, self.base = kept.astype(np.int32), weights.astype(np.float32), float(base)

    def score(self, col) -> np.ndarray:
        place = np.full(1 << BITS, -1, np.int32)
        place[self.kept] = np.arange(len(self.kept))
        out = np.full(len(col), self.base)
        for i, j, h, row in features(col):
            at = place[h]
            some = at >= 0
            f, r = present(at[some], row[some])
            out[i:j] += np.bincount(r, self.weights[f], j - i) if len(f) else 0
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def class_counts(sample: DataFrame) -> np.ndarray:
    """(2, 2 ** BITS) documents of each class (text, y) that hold a feature, summed on Spark by slice of the table."""
    width = (1 << BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = np.zeros((2, 1 << BITS), np.int32)
        for b in slices(batches, 2048):
            y = np.asarray(b.column("y"), np.int64)
            for i, _, h, row in features(b.column("text")):
                f, r = present(h, row)
                for k in (0, 1):
                    got[k] += np.bincount(f[y[i + r] == k], minlength=1 << BITS).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(SLICES), pa.int32()), pa.array([got[:, s * width:(s + 1) * width].tobytes() for s in range(SLICES)])],
            ["slice", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(2 * width, np.int64)
        for x in t.column("counts"):
            total += np.frombuffer(x.as_buffer(), np.int32)
        return pa.table({"slice": t.column("slice")[:1], "counts": pa.array([total.astype(np.int32).tobytes()], pa.binary())})

    few = sample.select("y", "text").mapInArrow(count, "slice int, counts binary")
    rows = few.groupBy("slice").applyInArrow(add, "slice int, counts binary").toPandas()
    out = np.zeros((2, 1 << BITS), np.int64)
    for s, x in zip(rows["slice"], rows["counts"], strict=True):
        out[:, s * width:(s + 1) * width] = np.frombuffer(x, np.int32).reshape(2, width)
    return out


def fit_toxicity(sample: DataFrame, steps: int = 300, shrink: float = 1e-4) -> NgramModel:
    """Model from labelled rows (text, y). Without rows or with one class only: the smoothed share of label 1."""
    sample = sample.persist()  # bounded; a lost block is computed again
    per = {int(r["y"]): r["count"] for r in sample.groupBy("y").count().collect()}
    n0, n1 = per.get(0, 0), per.get(1, 0)
    base = np.log((n1 + 1) / (n0 + 1))
    if not n0 or not n1:
        return NgramModel(np.zeros(0), np.zeros(0), base)
    c0, c1 = class_counts(sample)
    ratio = np.log((c1 + 0.5) / (n1 + 1)) - np.log((c0 + 0.5) / (n0 + 1))
    gain = np.abs(c1 / n1 - c0 / n0) * np.abs(ratio)
    kept = np.sort(np.lexsort((np.arange(len(gain)), -gain))[:MAX_FEATURES])
    kept = kept[gain[kept] > 0]
    if not len(kept):
        return NgramModel(np.zeros(0), np.zeros(0), base)
    place = np.full(1 << BITS, -1, np.int32)
    place[kept] = np.arange(len(kept))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            found = [np.zeros(0, np.uint16)] * b.num_rows
            for i, j, h, row in features(b.column("text")):
                at = place[h]
                f, r = present(at[at >= 0], row[at >= 0])
                for k, x in enumerate(np.split(f.astype(np.uint16), np.searchsorted(r, np.arange(1, j - i)))):
                    found[i + k] = x
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array([x.tobytes() for x in found], pa.binary())], ["y", "features"])

    t: pd.DataFrame = sample.select("y", "text").mapInArrow(rows, "y int, features binary").toPandas().sort_values(["y", "features"])
    f = [np.frombuffer(x, np.uint16) for x in t["features"]]
    row, col = np.repeat(np.arange(len(f)), [len(x) for x in f]), np.concatenate([*f, np.zeros(0, np.uint16)]).astype(np.int64)
    y, r = t["y"].to_numpy(float), ratio[kept]
    fair = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both classes weigh the same
    # Each text's features are scaled to length one in the fit's step size only: weights act on r * present.
    x = r[col]
    size = np.sqrt(np.bincount(row, x * x, len(y)).max() + 1)
    w, at, b, old, t0 = np.zeros(len(kept)), np.zeros(len(kept)), 0.0, np.zeros(len(kept)), 1.0
    rate = 4 / size ** 2 * 8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * at[col], len(y)) + b, -50, 50)))
        g = fair * (p - y)
        w = at - rate * (np.bincount(col, x * g[row], len(kept)) + shrink * at)
        b -= 0.5 * g.sum()
        t1 = (1 + np.sqrt(1 + 4 * t0 * t0)) / 2
        at, old, t0 = w + (t0 - 1) / t1 * (w - old), w, t1
    return NgramModel(kept, w * r, b)


def with_toxicity(docs: DataFrame, model: NgramModel, text: str = "text", score: str = "score", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and the score (0 to 1) of each whole text; a null text scores as the empty one. The model is bounded
    by ``MAX_FEATURES`` and travels with the function."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(model.score(b.column(text)))], [*keep, score])

    needed = docs.select(*(F.col(f"`{k}`") for k in dict.fromkeys([*keep, text])))
    return needed.mapInArrow(run, ", ".join([*ddl(docs, keep), f"`{score}` double"]))

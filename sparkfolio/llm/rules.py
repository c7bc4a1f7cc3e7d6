"""Quality by a sparse rule ensemble.

Small boosted trees over text statistics give paths; each path is a conjunction of comparisons. A
lasso logistic fit weighs the conjunctions, most weights end at zero, and what is left is compiled
into one Spark column expression. Fitting happens on a bounded sample of labelled rows
(``training.MAX_ROWS``); statistics and scores cover every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.textnum import SPACE, ddl, release, slices, mixed, prefix_sums, range_hash, runs_of_rows, text_bytes, U, words

STATS = ("bytes", "words", "word_bytes", "word_spread", "marks", "digits", "upper", "beyond_ascii", "lines", "line_bytes",
         "distinct_words", "repeated_next", "ended_words", "odd_marks", "distinct_lines", "top_byte")

RUN = 1 << 18  # bytes whose figures are held at a time, some 80 bytes for each
_KIND = np.zeros((256, 8), np.int32)  # marks, digits, upper, beyond ASCII, line ends, odd marks, letters, spaces
_KIND[33:48, 0] = _KIND[58:65, 0] = _KIND[91:97, 0] = _KIND[123:127, 0] = 1
_KIND[48:58, 1] = _KIND[65:91, 2] = _KIND[128:, 3] = _KIND[10, 4] = 1
_KIND[list(b"#$%&*+/<=>@\\^_`{|}~"), 5] = 1
_KIND[65:91, 6] = _KIND[97:123, 6] = _KIND[128:, 6] = 1
_KIND[:, 7] = SPACE


def _distinct(h: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Number of distinct values of each row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=n)


def text_stats(col) -> np.ndarray:
    """(rows, len(STATS)) figures of each whole text; null and empty texts have zeros only."""
    buf, offs = text_bytes(col)
    out = np.zeros((len(offs) - 1, len(STATS)))
    for i, j in runs_of_rows(offs, RUN):
        b, at = buf[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        if not len(b):
            continue
        n, size = j - i, np.diff(at)
        rows = np.repeat(np.arange(n), size)
        counts = np.bincount(rows * 256 + b, minlength=n * 256).reshape(n, 256)
        kinds = counts @ _KIND
        s, e = words(b, at)
        row = rows[s]
        n_words = np.bincount(row, minlength=n)
        w = (e - s).astype(float)
        mean = np.bincount(row, w, n) / np.maximum(1, n_words)
        var = np.bincount(row, w * w, n) / np.maximum(1, n_words) - mean ** 2
        sums = prefix_sums(b)
        h = mixed(range_hash(sums, s, e) + (e - s).astype(U))
        same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        ends_odd = _KIND[b[e - 1], 0] > 0 if len(e) else np.zeros(0, bool)
        cut = np.union1d(np.flatnonzero(b == 10) + 1, at[:-1][size > 0])
        cut = cut[cut < len(b)]
        till = np.append(cut[1:], len(b))
        lines = mixed(range_hash(sums, cut, till) + U(1))
        n_lines = np.bincount(rows[cut], minlength=n)
        some, per = np.maximum(1, size), np.maximum(1, n_words)
        out[i:j] = np.column_stack([
            size, n_words, mean, np.sqrt(np.maximum(0, var)), kinds[:, 0] / some, kinds[:, 1] / some,
            kinds[:, 2] / np.maximum(1, kinds[:, 6]), kinds[:, 3] / some, n_lines, size / np.maximum(1, n_lines),
            _distinct(h, row, n) / per, np.bincount(row[1:][same], minlength=n) / per,
            np.bincount(row[ends_odd], minlength=n) / per, kinds[:, 5] / per,
            _distinct(lines, rows[cut], n) / np.maximum(1, n_lines), np.where(_KIND[:, 7] > 0, 0, counts).max(1) / some])
    return out


def with_stats(docs: DataFrame, text: str = "text", prefix: str = "stat_") -> DataFrame:
    """``docs`` with one double column for each of ``STATS``; columns of those names are replaced.

    Each row by itself: repeated rows, nulls elsewhere and empty tables pass through.
    """
    own = [prefix + s for s in STATS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            figures = text_stats(b.column(text))
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n not in own]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(figures[:, k]) for k in range(len(STATS))],
                                             [n for n, _ in kept] + own)
        release()

    return docs.mapInArrow(run, ", ".join([*ddl(docs, (n for n in docs.columns if n not in own)), *(f"`{c}` double" for c in own)]))


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, is it above?, threshold)


@dataclass(frozen=True)
class RuleEnsemble:
    """Logistic model over rules; compiled to a Spark column or used on an array of figures."""

    base: float
    rules: tuple[tuple[Rule, float], ...]

    def score_column(self, prefix: str = "stat_") -> Column:
        total = F.lit(self.base)
        for rule, weight in self.rules:
            holds = F.lit(True)
            for k, above, cut in rule:
                c = F.col(prefix + STATS[k])
                holds = holds & ((c > cut) if above else (c <= cut))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for rule, weight in self.rules:
            z += weight * matches(x, rule)
        return 1 / (1 + np.exp(-z))


def matches(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, cut in rule:
        out &= (x[:, k] > cut) if above else (x[:, k] <= cut)
    return out


def _tree(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int,
          least: int) -> tuple[list[Rule], np.ndarray]:
    """Paths of one regression tree grown on binned figures, and its step for each row."""
    paths: list[Rule] = []
    step = np.zeros(len(x))

    def grow(rows: np.ndarray, path: Rule) -> None:
        g, h = grad[rows], hess[rows]
        best = (1e-6, None)
        if len(path) < depth and len(rows) >= 2 * least:
            whole = g.sum() ** 2 / (h.sum() + 1)
            for k, c in enumerate(cuts):
                if not len(c):
                    continue
                b = bins[rows, k]
                gl = np.cumsum(np.bincount(b, g, len(c) + 1))[:-1]
                hl = np.cumsum(np.bincount(b, h, len(c) + 1))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=len(c) + 1))[:-1]
                gain = gl ** 2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - whole
                gain[(nl < least) | (len(rows) - nl < least)] = -1
                m = int(gain.argmax())
                if gain[m] > best[0]:
                    best = (gain[m], (k, m))
        if path:
            paths.append(path)
        if best[1] is None:
            step[rows] = g.sum() / (h.sum() + 1)
            return
        k, m = best[1]
        above = bins[rows, k] > m
        grow(rows[~above], (*path, (k, False, float(cuts[k][m]))))
        grow(rows[above], (*path, (k, True, float(cuts[k][m]))))

    grow(np.arange(len(x)), ())
    return paths, step


def _simple(rule: Rule) -> Rule:
    """The same conjunction with one bound for each side of a statistic."""
    tight: dict[tuple[int, bool], float] = {}
    for k, above, cut in rule:
        old = tight.get((k, above), cut)
        tight[k, above] = max(old, cut) if above else min(old, cut)
    return tuple(sorted((k, above, cut) for (k, above), cut in tight.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, bins: int = 32, rate: float = 0.3,
              penalty: float = 0.002, steps: int = 400) -> RuleEnsemble:
    """Fit on figures ``x`` and labels 0/1 ``y``. Without rows, or with one class only, the score is the smoothed share
    of label 1 (0.5 without rows). The result does not depend on the order of rows beyond rounding."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    if len(y) < 10 or y.min() == y.max():
        return RuleEnsemble(base, ())
    cuts = [np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins)) for k in range(x.shape[1])]
    cuts = [c[c < x[:, k].max()] for k, c in enumerate(cuts)]
    binned = np.column_stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)])
    z, found = np.full(len(y), base), {}
    least = max(2, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        paths, step = _tree(x, binned, cuts, y - p, p * (1 - p), depth, least)
        z += rate * step
        found.update(dict.fromkeys(map(_simple, paths)))
    rules = sorted(found)
    hits = np.column_stack([matches(x, r) for r in rules]).astype(np.float32)
    rules = [r for r, keep in zip(rules, (hits.min(0) < hits.max(0)), strict=True) if keep]
    hits = hits[:, hits.min(0) < hits.max(0)]
    if not rules:
        return RuleEnsemble(base, ())
    # Accelerated proximal gradient for the lasso logistic weights; the intercept is not shrunk.
    spread = hits.std(0)
    design = (hits - hits.mean(0)) / spread
    v = np.random.default_rng(0).normal(size=len(rules)).astype(np.float32)
    for _ in range(15):
        v = design.T @ (design @ v)
        v /= np.linalg.norm(v)
    lipschitz = float(np.linalg.norm(design @ v) ** 2) / len(y) / 4 * 1.05 + 0.25
    w, old, b, t = np.zeros(len(rules), np.float32), np.zeros(len(rules), np.float32), base, 1.0
    at = w
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(design @ at + b)))
        w = at - (design.T @ (p - y)).astype(np.float32) / len(y) / lipschitz
        w = (np.sign(w) * np.maximum(np.abs(w) - penalty / lipschitz, 0)).astype(np.float32)
        b -= float((p - y).mean()) / 0.25 * 0.5
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, old, t = w + np.float32((t - 1) / t2) * (w - old), w, t2
    raw = w / spread
    kept = tuple((r, float(k)) for r, k in zip(rules, raw, strict=True) if abs(k) > 1e-6)
    return RuleEnsemble(float(b - (raw * hits.mean(0)).sum()), kept)


def fit_quality(sample: DataFrame) -> RuleEnsemble:
    """Model from labelled rows (text, y); the figures, not the texts, come to the driver (16 doubles a row, rows
    bounded by ``training.labelled_sample``)."""
    own = [f"stat_{s}" for s in STATS]
    t = with_stats(sample.select("y", "text")).select("y", *own).toPandas().sort_values([*own, "y"])
    return fit_rules(t[own].to_numpy(float), t["y"].to_numpy(float))

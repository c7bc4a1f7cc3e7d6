"""Mixing sources to target weights by iterative proportional fitting.

Token counts are added up by cell (source, language, topic). The cells' weights are raked until the weighted tokens have the target
shares of every margin, then turned into keep probabilities that give the asked number of tokens, and documents are drawn by a hash of
their id. Values without a target of their own share the margin's "*", so there are never more cells than the product of the
targets' sizes, however large the table is: only these few sums reach the driver. A margin without a target for "*" leaves
these values, nulls among them, the share of tokens that they have; the targets divide the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REST = "*"
MAX_CELLS = 1_000_000


def topic_of(text: Column) -> Column:
    """A plain topic of a text: code, legal, contact, table, or prose."""
    t = F.coalesce(text, F.lit(""))
    has = lambda *words: F.greatest(*(F.contains(t, F.lit(w)) for w in words)) if len(words) > 1 else F.contains(t, F.lit(words[0]))
    return (F.when(has("License", "rights reserved"), "legal").when(has("@", "+1 ("), "contact")
            .when(has(" | "), "table").when(has("{", "};", "$$"), "code").otherwise("prose"))


def token_count(text: Column) -> Column:
    """Blanks and line ends plus one; null and empty texts have none."""
    t = F.coalesce(text, F.lit(""))
    gaps = F.length(t) - F.length(F.translate(t, " \n\t\r", ""))
    return F.when(F.length(t) == 0, F.lit(0)).otherwise(gaps + 1).cast("long")


@dataclass(frozen=True)
class Mix:
    """Outcome of raking: rows (values of the margins, tokens, weight, probability), the largest miss of a share, and steps."""

    margins: tuple[str, ...]
    cells: tuple[tuple, ...]
    miss: float
    steps: int


def rake(sums: np.ndarray, targets: list[np.ndarray], tolerance: float = 1e-9, most: int = 500) -> tuple[np.ndarray, float, int]:
    """Weights of the cells of ``sums`` (one axis for each margin) so that the weighted sums meet ``targets`` (shares that
    add up to 1). Margin values without tokens cannot be met; their share goes to the others. Returns weights, the
    largest miss of a share, and the number of rounds."""
    w = np.ones_like(sums)
    if not sums.sum():
        return w, 0.0, 0
    goal = []
    for a, t in enumerate(targets):
        there = sums.sum(axis=tuple(i for i in range(sums.ndim) if i != a)) > 0
        t = np.where(there, t, 0.0)
        goal.append(t / t.sum() if t.sum() else there / there.sum())
    miss = np.inf
    for step in range(1, most + 1):  # noqa: B007
        miss = 0.0
        for a, t in enumerate(goal):
            axes = tuple(i for i in range(sums.ndim) if i != a)
            x = w * sums
            now = x.sum(axis=axes) / x.sum()
            miss = max(miss, float(np.abs(now - t).max()))
            f = np.divide(t, now, out=np.ones_like(t), where=now > 0)
            w = w * f.reshape([-1 if i == a else 1 for i in range(sums.ndim)])
        if miss < tolerance:
            break
    return w, miss, step


def probabilities(sums: np.ndarray, weights: np.ndarray, tokens: float) -> np.ndarray:
    """min(1, scale * weight) with the scale that keeps ``tokens`` tokens in expectation, all if there are fewer."""
    if tokens >= sums[weights > 0].sum():
        return (weights > 0).astype(float)
    p = np.zeros_like(weights)
    full = np.zeros(weights.shape, bool)
    while True:
        free = (weights * sums)[~full].sum()
        scale = max(0.0, tokens - sums[full].sum()) / free if free else 0.0
        new = ~full & (scale * weights > 1)
        if not new.any():
            p[~full] = scale * weights[~full]
            p[full] = 1
            return p
        full |= new


def goals(target: dict[str, float], values: list[str], tokens: np.ndarray) -> np.ndarray:
    """Target shares of ``values``, of which the last is "*", for a margin with these ``tokens``."""
    t = np.where(tokens > 0, [target.get(v, 0.0) for v in values], 0.0)
    if REST not in target and tokens.sum():
        rest = tokens[-1] / tokens.sum()
        t = t / t.sum() * (1 - rest) if t.sum() else t
        t[-1] = rest
    return t


def fit_mix(docs: DataFrame, targets: dict[str, dict[str, float]], tokens: Column, keep: float) -> Mix:
    """Rake ``docs`` (with one string column for each margin of ``targets``) and keep the share ``keep`` of its tokens."""
    margins = tuple(targets)
    if np.prod([len(t) + 1 for t in targets.values()]) > MAX_CELLS:
        raise ValueError(f"targets make more than {MAX_CELLS} cells")
    values = [[*(v for v in sorted(targets[m]) if v != REST), REST] for m in margins]
    sums = np.zeros([len(v) for v in values])
    rows = docs.select(*(pooled(F.col(f"`{m}`"), targets[m]).alias(m) for m in margins), tokens.alias("tokens")).groupBy(*margins).agg(F.sum("tokens").alias("tokens"))
    for r in rows.collect():
        sums[tuple(v.index(r[m]) for m, v in zip(margins, values, strict=True))] += r["tokens"] or 0
    weights, miss, steps = rake(sums, [goals(targets[m], v, sums.sum(axis=tuple(i for i in range(sums.ndim) if i != a)))
                                       for a, (m, v) in enumerate(zip(margins, values, strict=True))])
    p = probabilities(sums, weights, keep * sums.sum())
    cells = tuple((*(v[i] for v, i in zip(values, at, strict=True)), float(sums[at]), float(weights[at]), float(p[at]))
                  for at in np.ndindex(*sums.shape) if sums[at] > 0)
    return Mix(margins, cells, miss, steps)


def pooled(value: Column, target: dict[str, float]) -> Column:
    """Null and values without a target of their own become "*"."""
    return F.when(value.isin([v for v in target if v != REST]), value).otherwise(F.lit(REST))


def draw(id_col: Column, seed: int = 0) -> Column:
    """Number from 0 to below 1 that depends on the id and the seed only; a null id draws like any other value."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))


def with_mix(docs: DataFrame, mix: Mix, targets: dict[str, dict[str, float]], id_col: Column, seed: int = 0) -> DataFrame:
    """``docs`` with mix_weight, mix_probability and mix_kept. Documents of cells without tokens (empty texts) have
    weight and probability 1. Equal ids draw alike; extra columns pass through."""
    schema = ", ".join([*(f"`_{m}` string" for m in mix.margins), "mix_weight double", "mix_probability double"])
    cells = docs.sparkSession.createDataFrame([(*c[:len(mix.margins)], c[-2], c[-1]) for c in mix.cells], schema)
    keyed = docs.select("*", *(pooled(F.col(f"`{m}`"), targets[m]).alias(f"_{m}") for m in mix.margins))
    one = F.lit(1.0)
    joined = keyed.join(F.broadcast(cells), [f"_{m}" for m in mix.margins], "left").drop(*(f"_{m}" for m in mix.margins))
    return (joined.withColumn("mix_weight", F.coalesce("mix_weight", one)).withColumn("mix_probability", F.coalesce("mix_probability", one))
            .withColumn("mix_kept", draw(id_col, seed) < F.col("mix_probability")))

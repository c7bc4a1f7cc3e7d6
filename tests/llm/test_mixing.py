"""Raking meets the targets; draws follow the probabilities."""

import numpy as np
import pytest

from sparkfolio.llm import mixing
from sparkfolio.llm.queries import MIX_KEEP, MIX_TARGETS, QUERIES, mixed
from tests.conftest import SF


@pytest.mark.parametrize("seed", range(4))
def test_rake_meets_margins(seed):
    g = np.random.default_rng(seed)
    sums = g.integers(1, 1000, (3, 4, 2)).astype(float)
    targets = [t / t.sum() for t in (g.random(3), g.random(4), g.random(2))]
    w, miss, _ = mixing.rake(sums, targets)
    assert miss < 1e-8
    for a, t in enumerate(targets):
        x = (w * sums).sum(axis=tuple(i for i in range(3) if i != a))
        assert np.allclose(x / x.sum(), t, atol=1e-7)


def test_values_without_tokens():
    w, miss, _ = mixing.rake(np.array([[4.0, 6.0], [0.0, 0.0]]), [np.array([0.5, 0.5]), np.array([0.3, 0.7])])
    x = (w * np.array([[4.0, 6.0], [0.0, 0.0]]))[0]
    assert miss < 1e-8 and np.allclose(x / x.sum(), [0.3, 0.7])


def test_probabilities_keep_the_tokens():
    sums, w = np.array([10.0, 20, 30, 40]), np.array([9.0, 1, 0.5, 0.1])
    p = mixing.probabilities(sums, w, 35)
    assert (p <= 1).all() and (p * sums).sum() == pytest.approx(35) and p[0] == 1
    assert (mixing.probabilities(sums, w, 500) == 1).all()


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op6_source_mixing"](spark, SF).collect()
    n = {i: (len(t) - len(t.translate({32: None, 10: None, 13: None, 9: None})) + 1 if t else 0) for i, t in docs.items()}
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    total = sum(n.values())
    assert sum(r.mix_probability * n[r.doc_id] for r in rows) == pytest.approx(MIX_KEEP * total, rel=1e-6)
    weighted = sum(r.mix_weight * n[r.doc_id] for r in rows)
    goal = MIX_TARGETS["lang"]
    there = {k: v for k, v in goal.items() if k in {r.lang for r in rows}}
    for k, v in there.items():
        assert sum(r.mix_weight * n[r.doc_id] for r in rows if r.lang == k) / weighted == pytest.approx(v / sum(there.values()), abs=1e-4)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, tokens int"
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "*": 0.4}}
    rows = [(1, "x y", "en", "a", 1), (1, "x y", "en", "a", 1), (None, None, None, None, None), (2, "z " * 50_000, "de", "b", 0), (3, "", "en", "b", 2)]
    docs = spark.createDataFrame(rows, schema)
    mix = mixing.fit_mix(docs, targets, mixing.token_count(mixing.F.col("text")), 1.0)
    got = mixing.with_mix(docs, mix, targets, mixing.F.col("doc_id")).collect()
    assert len(got) == 5 and all(r.mix_kept is not None and r.mix_weight >= 0 for r in got)
    assert got[0].mix_kept == got[1].mix_kept
    none = docs.limit(0)
    assert mixing.with_mix(none, mixing.fit_mix(none, targets, mixing.token_count(mixing.F.col("text")), 0.5), targets, mixing.F.col("doc_id")).count() == 0


def plain_probabilities(rows):
    """doc_id -> keep probability, for (doc_id, text, lang, source) rows, by sums in dictionaries."""
    def topic(t):
        for name, words in (("legal", ["License", "rights reserved"]), ("contact", ["@", "+1 ("]), ("table", [" | "]), ("code", ["{", "};", "$$"])):
            if any(w in t for w in words):
                return name
        return "prose"

    cell, sums = {}, {}
    for i, text, lang, source in rows:
        key = tuple(v if v in MIX_TARGETS[m] else "*" for m, v in (("source", source), ("lang", lang), ("topic", topic(text or ""))))
        cell[i] = key
        sums[key] = sums.get(key, 0) + (1 + sum(text.count(c) for c in " \n\t\r") if text else 0)
    sums = {k: v for k, v in sums.items() if v}
    total = sum(sums.values())

    def margin(x, a):
        out = {}
        for k, v in x.items():
            out[k[a]] = out.get(k[a], 0) + v
        return out

    goal = []
    for a, m in enumerate(("source", "lang", "topic")):
        have = margin(sums, a)
        listed = {v: MIX_TARGETS[m][v] for v in have if v in MIX_TARGETS[m]}
        rest = have.get("*", 0) / total if "*" not in MIX_TARGETS[m] else 0
        goal.append({v: rest if v not in listed else listed[v] / sum(listed.values()) * (1 - rest) for v in have})
    x = dict(sums)
    for _ in range(500):
        for a in range(3):
            now, all_ = margin(x, a), sum(x.values())
            x = {k: v * goal[a][k[a]] / (now[k[a]] / all_) for k, v in x.items()}
    full = set()
    while True:
        scale = (MIX_KEEP * total - sum(sums[k] for k in full)) / sum(v for k, v in x.items() if k not in full)
        more = {k for k in x if k not in full and scale * x[k] / sums[k] > 1}
        if not more:
            return {i: 1.0 if k in full or k not in sums else scale * x[k] / sums[k] for i, k in cell.items()}
        full |= more


def plain_kept(spark, rows):
    p = plain_probabilities(rows)
    ids = spark.createDataFrame([(i,) for i in p], "doc_id long")
    return {r.doc_id for r in ids.select("doc_id", mixing.draw(mixing.F.col("doc_id"), 6).alias("u")).collect() if r.u < p[r.doc_id]}


def test_values_without_targets_keep_their_share(spark):
    """A third of all tokens in a source and a language without targets, nulls among them."""
    langs, odd = ["en", "de", "fr", "es"], [("new", "it"), (None, None), ("new", None)]
    rows = [(i, "a b c d", *(odd[i // 3 % 3] if i % 3 == 0 else (f"src{i % 20}", langs[i // 20 % 4]))) for i in range(3000)]
    rows = [(i, text, lang, source) for i, text, source, lang in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = mixed(docs).collect()
    other = [r.mix_probability for r in got if r.doc_id % 3 == 0]
    assert np.allclose(other, MIX_KEEP, atol=1e-6)
    assert {r.doc_id for r in got if r.mix_kept} == plain_kept(spark, rows)
    assert 300 < sum(r.mix_kept for r in got if r.doc_id % 3 == 0) < 500

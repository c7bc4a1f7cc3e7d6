"""Backoff scores against plain dictionaries of counts."""

import math
import re
import zlib
from collections import Counter

import pytest

from sparkfolio.llm import backoff
from sparkfolio.llm.queries import QUERIES
from tests.conftest import SF

END, START = object(), object()


def tokens(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", t), END]


def brute(rows):
    """rows: (id, text, learned)."""
    uni, pairs, before = Counter(), Counter(), Counter()
    for _, text, learned in rows:
        if learned:
            t = tokens(text)
            uni.update(t)
            pairs.update(zip([START, *t], t))
            before.update([START, *t[:-1]])
    before = {**before, **({END: uni[END]} if uni[END] else {})}
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, text, _ in rows:
        t = tokens(text)
        base = score = 0.0
        for p, x in zip([START, *t], t):
            base += math.log10((uni[x] + 1) / (n + v + 1))
            q = (uni[x] + 1) / (n + v + 1)
            score += math.log10(backoff.LAMBDA * pairs[p, x] / before[p] + (1 - backoff.LAMBDA) * q) if before.get(p) else math.log10(q)
        out.append((i, len(t), sum(uni[x] > 0 for x in t), n, base, score))
    return out


def same(got, want):
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=str), sorted(want, key=str)):
        assert g[:4] == w[:4] and g[4:] == pytest.approx(w[4:], rel=1e-9)


def rows_of(df):
    return [(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in df.collect()]


def test_query_against_brute_force(spark):
    docs = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = QUERIES["op7_backoff_scores"](spark, SF)
    same(rows_of(got), brute(docs))
    held = got.filter("held_out").collect()
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # the pairs help on texts that were not learned


def test_edges(spark):
    rows = [(1, "a b a b", True), (1, "a b a b", True), (2, None, True), (3, "", False), (None, "A\x0bb c", None), (4, "x " * 60_000, False), (5, "B a \t\n é É", True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, learned boolean").withColumn("batch", backoff.F.lit(7)).repartition(3)
    same(rows_of(backoff.lm_scores(df, backoff.F.col("learned"), n_batches=3)), brute(rows))
    assert backoff.lm_scores(df.limit(0), backoff.F.lit(True)).count() == 0
    same(rows_of(backoff.lm_scores(df, backoff.F.lit(False))), brute([(i, t, False) for i, t, _ in rows]))


def test_weights_add_up_to_one():
    """The arcs of a state, with the words beyond them and one unknown word, share the probability 1."""
    import numpy as np

    words = np.array([3, 5, 9], np.uint64)
    pairs = {(3, 5): 2, (3, 9): 1, (5, 3): 4, (9, 9): 1, (5, 9): 1}
    keys = {int(backoff.pair_keys(np.array([a], np.uint64), np.array([b], np.uint64))[0]): c for (a, b), c in pairs.items()}
    arcs = np.array(sorted(keys), np.uint64)
    m = backoff.Automaton(words, np.array([3, 5, 1], np.uint64), arcs, np.array([keys[int(k)] for k in arcs], np.uint64), 9, 3, 1)
    ask = np.array([3, 5, 9, 77], np.uint64)
    for state in (3, 5, 9):
        total = (10 ** m.traverse(np.full(4, state, np.uint64), ask)[2]).sum()
        assert total == pytest.approx(1)

"""Periodic runs: brute force on small alphabets, planted tails, odd rows, and the query over its whole table."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import runs
from sparkfolio.llm.queries import QUERIES
from tests.conftest import SF


def brute(w):
    """Every maximal stretch by definition."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and (i, j + q) not in out:
                out[i, j + q] = q
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in out.items())


def words_of(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is None:
        return w
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = words_of(doc_id, text)
    r = brute(w)
    gone = {i for s, n, q in r for i in range(s + q, s + n)}
    best = max(r, key=lambda x: (x[1], -x[0], -x[2])) if r else (None, None, None)
    return (len(r), *best, 1000 * best[1] // best[2] if r else None, hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in r).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_of_random_words(letters):
    rng = np.random.default_rng(letters)
    rows = [rng.integers(0, letters, int(n)).tolist() for n in rng.integers(0, 90, 150)]
    got = list(runs._found([[b"%d" % x for x in r] for r in rows]))
    assert got == [brute(r) for r in rows]


def test_runs_of_nested_periods():
    """Powers of words that hold powers themselves, with a letter changed here and there."""
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(200):
        w = rng.integers(0, 3, int(rng.integers(1, 5))).tolist()
        for _ in range(int(rng.integers(1, 4))):
            w = w * int(rng.integers(2, 7)) + rng.integers(0, 3, int(rng.integers(0, 3))).tolist()
            w = w[:400]
        if rng.random() < 0.5:
            w[int(rng.integers(0, len(w)))] = 9
        rows.append(w)
    assert list(runs._found([[b"%d" % x for x in r] for r in rows])) == [brute(r) for r in rows]


def test_a_false_hash_is_found_out():
    x = np.array([1, 2, 1, 2, 1, 2, 3, 2, 1])
    assert runs._exact(x, 0, 9, 2, 1) == (0, 6)
    assert runs._exact(x, 0, 6, 2, 1) == (0, 6)


def test_odd_rows(spark):
    long = " ".join(["a b c d e f g"] * 150)
    rows = [(None, "x x x x x x", 1), (1, None, 2), (2, "", 3), (2, "", 3), (3, " \t\n", 4), (4, "é é é é é é é", 5), (5, long, 6), (5, long, 6), (6, "A a A a A a A a", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int")
    got = runs.with_runs(docs, keep=("doc_id", "start"), mark=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    assert got.columns[:2] == ["doc_id", "start"]
    shown = sorted((tuple(r)[0], *tuple(r)[3:10]) for r in got.filter("doc_id is not null").collect())
    assert shown == sorted((i, *expected(i, t)) for i, t, _ in rows if i is not None)
    kept = {r.doc_id: r.collapsed for r in runs.with_runs(docs).collect()}
    assert kept[None] == "x" and kept[5] == "a b c d e f g" and kept[4] == "é" and kept[1] == kept[3] == ""
    assert runs.with_runs(docs.limit(0)).count() == 0
    tall = runs.with_runs(spark.createDataFrame([(1, "a b c d e f g " * 60_000)], "doc_id long, text string")).first()
    assert (tall.n_runs, tall.start, tall.length, tall.period, tall.collapsed) == (1, 0, 420_000, 7, "a b c d e f g")


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect() if len((r.text or "").split()) < 700}
    rows = QUERIES["op11_periodic_runs"](spark, SF).collect()
    assert len(rows) == docs.count()
    for r in rows:
        if r.doc_id in want:
            assert tuple(r)[1:] == expected(r.doc_id, want[r.doc_id]), r.doc_id
    assert sum(r.n_runs for r in rows) > 0

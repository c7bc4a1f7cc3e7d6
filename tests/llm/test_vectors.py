"""The metric range join against all pairs."""

import math
import random

import numpy as np
import pytest

from sparkfolio.llm import vectors
from sparkfolio.llm.queries import QUERIES
from tests.conftest import SF


def brute(rows, threshold=0.93):
    """rows: (id, label, vector); ids must differ."""
    def fine(lab, v):
        return lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    good = [(i, lab, np.array(v, float)) for i, lab, v in rows if fine(lab, v)]
    links, up = {i: set() for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for k, (i, la, a) in enumerate(good):
        for j, lb, b in good[:k]:
            if la == lb and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i].add(j)
                links[j].add(i)
                x, y = sorted((root(i), root(j)))
                up[y] = x
    return sorted((i, len(links[i]), root(i), root(i) == i) for i, _, _ in rows)


def made(seed, n=240, dim=8):
    g, r = np.random.default_rng(seed), random.Random(seed)
    rows = []
    centres = g.normal(size=(6, dim))
    for i in range(n):
        v = centres[r.randrange(6)] * r.uniform(0.1, 50) + g.normal(size=dim) * r.choice([0.0, 0.1, 0.4, 2])
        rows.append((i, r.choice(["a", "a", "a", "b"]), [float(x) for x in v]))
    odd = [None, [], [0.0] * dim, [float("nan")] * dim, [float("inf")] + [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [1.0, 2.0], [2.0, 4.0]]
    rows += [(n + k, "a", v) for k, v in enumerate(odd)] + [(n + 20, None, rows[0][2]), (n + 21, rows[0][1], rows[0][2]), (n + 22, rows[0][1], rows[0][2])]
    return rows


@pytest.mark.parametrize("seed,cell,block", [(1, 1000, 1024), (2, 10, 1024), (3, 12, 7)])
def test_against_all_pairs(spark, monkeypatch, seed, cell, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = made(seed)
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label string, embedding array<double>, point int").repartition(3)
    assert sorted(tuple(r) for r in vectors.near_vectors(df, cell=cell).collect()) == brute(rows)


def test_query_on_the_whole_table(spark):
    rows = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in QUERIES["op8_embedding_near_dedup"](spark, SF).collect()) == brute(rows)


def test_edges(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).count() == 0
    same = [(i, 1, [1.0, 2.0]) for i in range(50)] + [(50, 2, [1.0, 2.0]), (51, None, None)]
    got = {r.vec_id: tuple(r)[1:] for r in vectors.near_vectors(spark.createDataFrame(same, schema)).collect()}
    assert got == {**{i: (49, 0, i == 0) for i in range(50)}, 50: (0, 50, True), 51: (0, 51, True)}


def test_copies_follow_blocks(spark, monkeypatch):
    """Random vectors, where no cell can be ruled out: each is sent once for each block of its label, and no block is larger than BLOCK."""
    monkeypatch.setattr(vectors, "BLOCK", 100)
    g, keep, sent = np.random.default_rng(7), vectors._met, spark.sparkContext.accumulator(0)

    def counting(t, threshold):
        assert len(t) <= 2 * 100 * 1.5  # parts are dealt by a hash
        sent.add(len(t))
        return keep(t, threshold)

    monkeypatch.setattr(vectors, "_met", counting)
    rows = [(i, "a", [float(x) for x in g.normal(size=32)]) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<double>")
    assert sorted(tuple(r) for r in vectors.near_vectors(df, cell=200).collect()) == brute(rows)
    assert sent.value <= 600 * 9


def test_links_across_blocks_and_tiles(spark, monkeypatch):
    """Floats, one label, one great cluster beside loose vectors; blocks and tiles far smaller than the label."""
    monkeypatch.setattr(vectors, "BLOCK", 20)
    monkeypatch.setattr(vectors, "TILE", (7, 5))
    g = np.random.default_rng(8)
    centre = g.normal(size=16)
    rows = [(i, "a", [float(np.float32(x)) for x in (centre + g.normal(size=16) * 0.2 if i % 2 else g.normal(size=16))]) for i in range(160)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    assert sorted(tuple(r) for r in vectors.near_vectors(df, cell=40).collect()) == brute(rows)

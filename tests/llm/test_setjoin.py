"""The Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from sparkfolio.llm import setjoin


def brute(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), i))
    return sorted((-1 if i is None else i, len(sets[a]), least.get(root(a), -1)) for a, (i, _) in enumerate(rows))


def made(seed, edits):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdef") for _ in range(r.randint(1, 4)))
    text = lambda n: [word() for _ in range(n)]
    rows = [" ".join(text(r.randint(0, 60))) for _ in range(60)]
    for n in (12, 40, 120, 300):
        base = text(n)
        for _ in range(25):
            w = list(base)
            for _ in range(r.randint(0, max(1, n * edits // 100))):
                w[r.randrange(len(w))] = word()
            rows.append(" ".join(w[: r.randint(n - n // 12, n)]))
    line = " ".join(text(20))
    rows += [" ".join(text(10)) + "\n" + line for _ in range(20)]
    rows += ["", None, " \n", "Aa b", "aA b", "É b", "é b", rows[3], rows[3]]
    return list(enumerate(rows))


@pytest.mark.parametrize("seed,edits,block", [(1, 3, 256), (2, 6, 8), (3, 4, 4)])
def test_against_all_pairs(spark, monkeypatch, seed, edits, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    rows = made(seed, edits)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, node string").repartition(4)
    got = sorted(tuple(r) for r in setjoin.jaccard_components(df).collect())
    assert got == brute(rows)


def test_edges(spark):
    schema = "doc_id long, text string"
    assert setjoin.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "a b c d e f"), (7, "a b c d e f"), (3, "A b c d e f"), (None, "a b c d e f"), (9, None), (None, None)]
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id)
                 for r in setjoin.jaccard_components(spark.createDataFrame(rows, schema)).collect())
    assert got == [(-1, 0, -1), (-1, 2, 3), (3, 2, 3), (7, 2, 3), (7, 2, 3), (9, 0, 9)]


def test_derived_links():
    r = np.random.default_rng(4)
    leader = np.unique(r.integers(0, 1 << 60, 300, dtype=np.uint64))
    sets = [np.unique(np.concatenate([r.choice(leader, 250, replace=False), r.integers(0, 400, 30, dtype=np.uint64)])) for _ in range(40)]
    got = setjoin.derived_links(sets[:15], sets, leader)
    for i in range(15):
        for j in range(40):
            x, y = set(sets[i].tolist()), set(sets[j].tolist())
            assert got[i, j] == (100 * len(x & y) >= 80 * len(x | y))

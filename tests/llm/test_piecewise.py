"""Piecewise fingerprints: chunk by chunk and cell by cell brute force, order of documents, odd rows, the query over its table."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from sparkfolio.llm import piecewise as pw
from sparkfolio.llm.queries import QUERIES
from tests.conftest import SF

M = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def mix(h):
    for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h = (h ^ (h >> 33)) * c & M
    return h ^ (h >> 33)


def poly(b):
    return sum((x + 1) * pow(BASE, i, 1 << 64) for i, x in enumerate(b)) & M


def brute_print(text):
    b = text.encode()
    level = {}
    for end in range(7, len(b)):
        h = mix(poly(b[end - 7:end]) ^ BASE)
        level[end] = min((h & -h).bit_length() - 1 if h else 47, 47)

    def chunks(k):
        cuts = [0, *(e for e in sorted(level) if level[e] >= k), len(b)]
        return [mix((poly(b[x:y]) + y - x) & M) >> 52 for x, y in zip(cuts, cuts[1:]) if y > x]

    k = next(k for k in range(49) if sum(v >= k for v in level.values()) + 1 <= 64)
    return k, chunks(k), chunks(k + 1)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute_likeness(f, g):
    if f == g:
        return 1.0
    best = 0.0
    for x in (1, 2):
        for y in (1, 2):
            if f[0] + x == g[0] + y and f[x] and g[y]:
                best = max(best, 1 - brute_distance(f[x], g[y]) / max(len(f[x]), len(g[y])))
    return best


def plain(f):
    return f[0], f[1].tolist(), f[2].tolist()


TEXTS = ["", "a", "abcdefg", "abcdefgh", "é" * 9, "ab" * 300, "x" * 5000] + [
    " ".join(f"w{x}" for x in np.random.default_rng(i).integers(0, 9999, 12 * i * i + 3)) for i in range(12)]


def test_fingerprints_by_definition():
    got = pw.fingerprints(pa.array([*TEXTS, None]))
    assert [plain(f) for f in got] == [brute_print(t) for t in [*TEXTS, ""]]
    assert all(len(f[1]) <= pw.CHUNKS for f in got)
    assert [plain(pw.read(pw.written(f))) for f in got] == [plain(f) for f in got]
    assert pw.fingerprints(pa.array([], pa.string())) == []


def test_a_long_text_beside_short_ones():
    tall = "".join(f"{x} " for x in np.random.default_rng(1).integers(0, 10**6, 250_000))
    got = pw.fingerprints(pa.array(["abc", tall, "abc"]))
    assert plain(got[0]) == plain(got[2]) == brute_print("abc") and 16 <= len(got[1][1]) <= 64


@pytest.mark.parametrize("letters", [1, 2, 30])
def test_edit_distances(letters):
    rng = np.random.default_rng(letters)
    a, b = ([rng.integers(0, letters, int(n)) for n in rng.integers(0, 65, 120)] for _ in range(2))
    assert pw.edit_distances(a, b).tolist() == [brute_distance(x.tolist(), y.tolist()) for x, y in zip(a, b)]
    assert pw.edit_distances([], []).tolist() == []


def test_likeness():
    prints = pw.fingerprints(pa.array(TEXTS))
    pairs = [(f, g) for f in prints for g in prints]
    got = pw.likenesses([p[0] for p in pairs], [p[1] for p in pairs])
    assert np.allclose(got, [brute_likeness(plain(f), plain(g)) for f, g in pairs])


def expected(rows):
    out = []
    for (i, t), (_, u) in zip(rows, [*rows[1:], rows[0]]):
        e = t[:len(t) - len(t) // 3] + u[:len(t) // 3]
        f, g, h = map(brute_print, (t, e, u))
        text = lambda x: pw.written((x[0], np.array(x[1], np.int64), np.array(x[2], np.int64)))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), text(f), text(g), brute_likeness(f, g), brute_likeness(f, h)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want]) if want else not got


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_odd_rows(spark, ranges):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (50, None), (60, "z" * 30), (60, "z" * 30), (60, "z" * 30)]
    docs = spark.createDataFrame([(i, t, "range", 1) for i, t in rows], "doc_id long, text string, head string, tie int")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    try:
        got = pw.edit_report(docs.repartition(4)).collect()
        none = pw.edit_report(docs.limit(0)).collect()
        alone = pw.edit_report(docs.filter("doc_id = 9")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    same(got, expected([(i, t or "") for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0], reverse=True)]))
    same(alone, expected([(9, TEXTS[9])]))
    assert none == []


def test_columns_of_callers(spark):
    docs = spark.createDataFrame([(t, t[::-1]) for t in TEXTS] + [(None, "x")], "text string, fingerprint string")
    both = pw.with_fingerprint(pw.with_fingerprint(docs, "text", "a b"), "text")
    assert both.filter("`a b` <> fingerprint").count() == 0 and both.count() == len(TEXTS) + 1
    like = pw.with_likeness(both, "a b", "fingerprint")
    assert like.filter("likeness = 1").count() == len(TEXTS) + 1
    nulls = pw.with_likeness(both.selectExpr("fingerprint", "cast(null as string) as n"), "fingerprint", "n")
    assert nulls.filter("likeness is not null").count() == 0


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, (r.text or "")) for r in docs.orderBy("doc_id", ascending=False).collect()]
    got = {r.doc_id: tuple(r) for r in QUERIES["op13_piecewise_fingerprints"](spark, SF).collect()}
    assert len(got) == len(rows)
    pairs = list(zip(rows, [*rows[1:], rows[0]]))
    short = [k for k, ((_, t), (_, u)) in enumerate(pairs) if max(len(t), len(u)) < 1500]
    for k in short:
        want = expected([pairs[k][0], pairs[k][1]])[0]
        assert got[want[0]][:5] == want[:5] and np.allclose(got[want[0]][5:], want[5:])
    assert len(short) > 50
    assert np.mean([r[5] for r in got.values()]) > 0.6 > 0.3 > np.mean([r[6] for r in got.values()])

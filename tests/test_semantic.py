"""Semantic scores, the vector store, and the radius search."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sparkfolio.functions import search
from sparkfolio.functions.embedding import hashed_embedding
from sparkfolio.operators import matching as mt
from sparkfolio.operators import nearby
from sparkfolio.operators import semantic as sm
from sparkfolio.operators import vectorjoin as vj
from sparkfolio.sources.vector_store import VectorStore


def small(rows, text, out):
    return hashed_embedding(rows, text, out, 32)


def texts_of(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").withColumn("key", sm.text_id(F.col("text")))


def test_pieces_hold_the_whole_text(spark):
    df = spark.createDataFrame([("a b c d e",), ("",), (None,), (" x ",)], "t string").select("t", sm.pieces(F.col("t"), 2).alias("p"))
    got = {r.t: [(x.piece, x.n) for x in r.p] for r in df.collect()}
    assert got == {"a b c d e": [("a b", 2), ("c d", 2), ("e", 1)], "": [], None: [], " x ": [("x", 1)]}


def test_a_long_text_is_the_mean_of_its_pieces(spark):
    text = "engineer builds pipelines engineer tests pipelines teaches"
    whole = {r.key: list(r.vector) for r in sm.embed_texts(texts_of(spark, text, "", "the of"), small, max_words=3).collect()}
    parts = [list(r.v) for r in small(spark.createDataFrame([("engineer builds pipelines",), ("engineer tests pipelines",), ("teaches",)], "t string"), "t", "v").collect()]
    mean = [3 * a + 3 * b + c for a, b, c in zip(*parts)]
    size = math.sqrt(sum(x * x for x in mean))
    got = whole.pop(texts_of(spark, text).first().key)
    assert all(abs(a - b / size) < 1e-6 for a, b in zip(got, mean, strict=True))
    assert list(whole.values()) == [[], []]


def test_pair_similarity(spark):
    cv = spark.createDataFrame([(1, "python spark engineer"), (2, "nurse hospital care"), (3, None), (4, "python spark engineer")], "doc_id long, raw_text string")
    jobs = spark.createDataFrame([(10, "spark engineer python"), (11, "hospital nurse"), (12, "")], "listing_id long, description string")
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 11), (3, 10), (4, 10), (2, 12), (1, 10)], "doc_id long, listing_id long")
    seen = spark.sparkContext.accumulator(0)

    def counting(rows, text, out):
        rows.foreach(lambda _: seen.add(1))
        return small(rows, text, out)

    got = {(r.doc_id, r.listing_id): r.semantic for r in sm.pair_similarity(pairs, cv, jobs, counting).collect()}
    assert seen.value == 4  # two records share a text; null and empty ones have none
    assert got[1, 10] == pytest.approx(1) and got[4, 10] == got[1, 10] and got[1, 11] == 0 and got[3, 10] == 0 and got[2, 12] == 0
    assert got[2, 11] == pytest.approx(2 / math.sqrt(6), abs=1e-6) and len(got) == 6


def test_store_computes_once_and_survives_a_broken_version(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/v")
    first, more = texts_of(spark, "one two", "three four"), texts_of(spark, "one two", "five six", "five six", None)
    embed = lambda lacking: sm.embed_texts(lacking, small)
    assert store.ensure(first, embed) == 2 and store.ensure(first, embed) == 0
    assert store.ensure(more, embed) == 1 and store.ensure(more, embed) == 0
    held = {r.key: list(r.vector) for r in store.read().collect()}
    assert held == {r.key: list(r.vector) for r in sm.embed_texts(first.unionByName(more).filter("key is not null").distinct(), small).collect()}
    n, since, rows = store.versions()[0]
    (tmp_path / "v" / f"v{n}-from{since}-rows{rows}").rename(tmp_path / "v" / f"v{n}-from{since}-rows{rows + 1}")
    assert store.read().count() == 1 and store.ensure(first, embed) == 2  # the count does not fit: computed again
    assert {r.key: list(r.vector) for r in store.read().collect()} == held


def test_store_with_two_writers(spark, tmp_path):
    """What another writer appended meanwhile is there once."""
    a, b = (VectorStore(spark, f"{tmp_path}/v") for _ in range(2))
    rows = texts_of(spark, "one two", "three four")

    def slow(lacking):
        b.ensure(rows.filter("text = 'one two'"), lambda x: sm.embed_texts(x, small))
        return sm.embed_texts(lacking, small)

    assert a.ensure(rows, slow) == 2
    assert [v[:2] for v in a.versions()] == [(1, 0), (2, 0)]
    assert sorted(r.key for r in a.read().collect()) == sorted(r.key for r in rows.collect())


def test_scores_come_from_the_store(spark, tmp_path):
    store = VectorStore(spark, f"{tmp_path}/v")
    cv = spark.createDataFrame([(1, "python spark")], "doc_id long, raw_text string")
    jobs = spark.createDataFrame([(10, "spark python")], "listing_id long, description string")
    pairs = spark.createDataFrame([(1, 10)], "doc_id long, listing_id long")
    want = sm.pair_similarity(pairs, cv, jobs, small, store=store).first().semantic
    fails = lambda rows, text, out: 1 / 0
    assert sm.pair_similarity(pairs, cv, jobs, fails, store=store).first().semantic == want


def plain_km(a, o, b, p):
    a, o, b, p = map(math.radians, (a, o, b, p))
    return 2 * 6371.0 * math.asin(math.sqrt(min(1, math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin((p - o) / 2) ** 2)))


@pytest.mark.parametrize("km", [30, 700])
def test_within(spark, km):
    rnd = random.Random(km)
    spread = 2.0 if km == 30 else 90.0
    pts = [(i, max(-90.0, min(90.0, rnd.uniform(-1, 1) * spread + (45 if km == 30 else 0))), rnd.uniform(-1, 1) * (2 if km == 30 else 180)) for i in range(150)]
    pts += [(200, 89.9, 10.0), (201, 89.9, -170.0), (202, 0.0, 179.99), (203, 0.0, -179.99), (204, -90.0, 0.0), (205, None, 1.0), (206, 45.0, 0.0), (207, 45.0, 0.0)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = sorted((r.left_id, r.right_id) for r in nearby.within(df, df, km).collect())
    ok = [p for p in pts if p[1] is not None]
    assert got == sorted((i, j) for i, a, o in ok for j, b, p in ok if plain_km(a, o, b, p) <= km)


def test_search_radius(spark):
    """A listing 25 km away is found whatever its department, one 40 km away is not, and one that cannot be measured is found as before."""
    towns = [("a", "here", "59", 50.0, 3.0), ("b", "near", "62", 50.225, 3.0), ("c", "far", "59", 50.36, 3.0), ("d", "twin", "59", 50.0, 3.1), ("e", "twin", "13", 43.0, 5.0)]
    places = spark.createDataFrame(towns, "id string, name string, department string, lat double, lon double")
    rows = [(1, "59000 Here"), (2, "62000 Near"), (3, "59100 Far"), (4, "59200 Unknown"), (5, "62200 Unknown"), (6, "59300 Twin"), (7, "13000 Twin"), (8, None), (9, "Twin")]
    listings = spark.createDataFrame([(i, "Data engineer", p, "jooble") for i, p in rows], "listing_id long, title string, location string, source string")
    asks = [("59000 Here", 30), ("Here", 30), ("59000 Here", None), ("Atlantis", 30), ("France", None)]
    searches = spark.createDataFrame([("data engineer", p, d) for p, d in asks], "query string, place string, distance int").withColumn("area", search.search_area(F.col("place")))
    spots = mt.settled(searches, listings, places)
    answers = mt.answer_searches(spots, listings, places=places)
    got = {}
    for r in spots.join(answers, ["query", "area"]).collect():
        got.setdefault((r.place, r.distance), []).append(r.listing_id)
    got = {k: sorted(v) for k, v in got.items()}
    everywhere = list(range(1, 10))
    assert got == {("59000 Here", 30): [1, 2, 4, 6, 9], ("Here", 30): [1, 2, 6, 9], ("59000 Here", None): [1, 3, 4, 6], ("Atlantis", 30): everywhere, ("France", None): everywhere}
    assert spots.filter("place in ('Atlantis', 'France')").select("area").distinct().count() == 1  # answered once


@pytest.mark.parametrize("threshold", [0.9, 0.4, -0.2])
def test_index_gives_the_pairs_of_the_matrix(spark, threshold, monkeypatch):
    """Clustered vectors, zero vectors, equal ones; small blocks so that rings are cut."""
    monkeypatch.setattr(vj, "PER_CELL", 20)
    rnd = random.Random(5)
    middles = [[rnd.gauss(0, 1) for _ in range(8)] for _ in range(12)]
    near = lambda: [x + rnd.gauss(0, 0.3) for x in rnd.choice(middles)]
    a = spark.createDataFrame([(i, near()) for i in range(200)] + [(900, [0.0] * 8), (901, middles[0])], "id long, vector array<double>")
    b = spark.createDataFrame([(i, near()) for i in range(150)] + [(900, [0.0] * 8), (901, middles[0])], "phrase long, vector array<double>")
    rows = lambda d: sorted((r.id, r.phrase, round(r.sim, 9)) for r in d.collect())
    assert rows(vj.indexed_pairs(a, b, threshold, block=16)) == rows(vj.similar_pairs(a, b, threshold))


def test_a_high_threshold_asks_few_rings(spark, monkeypatch):
    """Copies of a vector follow the hits, not the number of blocks."""
    monkeypatch.setattr(vj, "PER_CELL", 8)
    sent = {}
    keep = vj.persisted
    monkeypatch.setattr(vj, "persisted", lambda df, name: sent.setdefault(name, keep(df, name)))
    angle = lambda i, n: [math.cos(2 * math.pi * i / n), math.sin(2 * math.pi * i / n)]
    a = spark.createDataFrame([(i, angle(i, 64)) for i in range(64)], "id long, vector array<double>")
    b = spark.createDataFrame([(i, angle(i, 640)) for i in range(640)], "phrase long, vector array<double>")
    assert vj.indexed_pairs(a, b, 0.9995).count() == 64 * 7
    assert sent["asks"].count() < 64 * 12 and sent["index"].select("cell", "ring").distinct().count() > 60


def test_best_in_blocks(spark):
    rnd = random.Random(1)
    a = spark.createDataFrame([(i % 5, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(90)], "owner long, vector array<double>")
    b = spark.createDataFrame([(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(30)], "phrase long, vector array<double>")
    best = lambda d: sorted((r.owner, r.phrase, round(r.sim, 9)) for r in d.collect())
    want = best(vj.best_per_phrase(a, b))
    assert best(vj._best_in_blocks(a, b, block=16)) == want
    hits = [x for x in want if x[2] >= 0.8]
    assert best(vj.hits_per_phrase(a, b, 0.8)) == best(vj.hits_per_phrase(a, b, 0.8, max_broadcast=3)) == hits


def test_skills_from_lines(spark):
    docs = spark.createDataFrame([(1, "Header\nmanage hospital care team\r\nsells"), (2, "hospital"), (3, None), (4, "hospital care\nmanage team\nproduce sales reports weekly")], "doc_id long, text string")
    phrases = spark.createDataFrame([(7, "manage hospital care"), (8, "produce sales reports"), (9, "of the")], "phrase long, text string")
    for bound in (100, 0):
        got = {(r.owner, r.phrase): round(r.sim, 4) for r in sm.semantic_skills_from_text(docs, phrases, 0.8, max_broadcast=bound).collect()}
        assert got == {(1, 7): round(3 / math.sqrt(12), 4), (4, 7): round(2 / math.sqrt(6), 4), (4, 8): round(3 / math.sqrt(12), 4)}


def test_dot_products_stay_in_the_row(spark):
    """Lengths may differ from row to row, rows may be null, empty or of two lengths; no pair's vectors go to Python."""
    from pyspark.sql import functions as F

    from sparkfolio.operators.semantic import _dot

    rows = [(1, [1.0, 2.0], [3.0, 4.0]), (2, None, [1.0]), (3, [], []), (4, [1.0, 2.0], [1.0]), (5, [0.5], [4.0]), (6, [1.0, 0.0, 2.0], [5.0, 7.0, -1.0]), (7, None, None)]
    shown = spark.createDataFrame(rows, "i int, a array<float>, b array<float>").select("i", _dot(F.col("a"), F.col("b")).alias("d"))
    assert "EvalPython" not in shown._jdf.queryExecution().executedPlan().toString()
    assert {r.i: r.d for r in shown.collect()} == {1: 11.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 2.0, 6: 3.0, 7: 0.0}

"""Profile catalogues of any size: the automaton path against a plain count, parts, odd rows."""

import random

from pyspark.sql import functions as F

from sparkfolio.operators import profiles as pf

RECORD = "doc_id long, skills_flat array<string>, sections map<string,string>, experience array<struct<bullets:array<string>>>, raw_text string"


def records(spark, n=12):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randint(1, 3)))
    rows = [(i, [word(), "Été"], {"skills": f"{word()} {word()}"}, [([f"{word()} {word()} {word()}"],)], word()) for i in range(n)]
    return spark.createDataFrame([*rows, (90, [], {}, [], "abc cab"), (91, None, None, None, None)], RECORD)


def catalogue(n):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abC") for _ in range(rnd.randint(0, 4)))
    return [(i, f"p{i}", f"s{i}", f"t{i}", [word() for _ in range(rnd.randint(0, 5))] + (["été"] if i % 9 == 0 else [])) for i in range(n)]


def plain(rows, texts, titles):
    """Best four by the definition: contained keywords over keywords."""
    out = {}
    for d, (sk, ex) in texts.items():
        scored = []
        for o, i, s, t, keywords in rows:
            share = lambda x: sum(k.lower() in (x or "") for k in keywords) / len(keywords) if keywords and x is not None else sum(k == "" for k in keywords) / max(1, len(keywords))
            scored.append((-(titles.get(i, 0.0) * 0.4 + share(sk) * 0.35 + share(ex) * 0.25), o, i))
        out[d] = sorted(scored)[:4]
    return out


def test_detect_by_definition(spark, monkeypatch):
    cv, rows, titles = records(spark), catalogue(150), {"p7": 0.9, "p8": -0.5}
    texts = {r.doc_id: (r.sk, r.ex) for r in cv.select("doc_id", pf.skills_text(F.col("skills_flat"), F.col("sections")).alias("sk"),
                                                       pf.experience_text(F.col("experience"), F.col("sections"), F.col("raw_text")).alias("ex")).collect()}
    table = spark.createDataFrame([*rows, rows[3], (1, None, "s", "t", ["a"])], pf.CATALOGUE_SCHEMA)
    given = F.create_map(*(x for k, v in titles.items() for x in (F.lit(k), F.lit(v))))
    want = plain(rows, texts, titles)
    for part in (50_000, 40):
        monkeypatch.setattr(pf, "PART", part)
        got = {r.doc_id: r for r in pf.detect(cv, table, given).collect()}
        assert got.keys() == want.keys()
        for d, r in got.items():
            best = [i for _, _, i in want[d]]
            sure = -want[d][0][0] >= 0.3
            assert [a.id for a in r.alternatives] == (best[1:4] if sure else best[:3]), d
            assert r.profile_id == (best[0] if sure else "non_detecte") and abs(r.confidence - max(0, min(1, -want[d][0][0]))) < 6e-4


def test_same_path_for_few_and_many(spark):
    cv, rows = records(spark, 3), catalogue(20_000)
    many = pf.detect(cv, spark.createDataFrame(rows, pf.CATALOGUE_SCHEMA))
    few = pf.detect(cv, spark.createDataFrame(rows[:134], pf.CATALOGUE_SCHEMA))
    name = lambda d: [x for x in ("Exchange", "Join") if x in d._jdf.queryExecution().executedPlan().toString()]
    assert name(many) == name(few) == [] and many.count() == few.count() == 5
    assert all(m.confidence >= f.confidence for m, f in zip(many.orderBy("doc_id").collect(), few.orderBy("doc_id").collect()))


def test_coverage_rows_and_empty_catalogue(spark):
    cv = records(spark, 2)
    rows = {(r.doc_id, r.profile_id): (r.skills, r.exp) for r in pf.profile_coverage(cv, [pf.Profile("x", "", "", [], ["abc", "zzz"]), pf.Profile("y", "", "")]).collect()}
    assert rows[90, "x"] == (0.0, 0.5) and rows[90, "y"] == (0.0, 0.0) and len(rows) == 8
    none = pf.detect(cv, spark.createDataFrame([], pf.CATALOGUE_SCHEMA)).collect()
    assert {(r.profile_id, r.confidence, len(r.alternatives)) for r in none} == {("non_detecte", 0.0, 0)}


def test_profiles_of_equal_keywords_are_scored_once(spark, monkeypatch):
    cv = records(spark)
    words = [r["keywords"] for r in [dict(zip(("ord", "id", "sector", "job", "keywords"), x, strict=True)) for x in catalogue(12)]]
    rows = [(i % 50, f"p{i}", "s", f"t{i}", words[i % 12]) for i in range(600)]
    table = spark.createDataFrame(rows, pf.CATALOGUE_SCHEMA)
    assert pf._reduced(table).count() <= 4 * 12
    want = {r.doc_id: r for r in pf.detect(cv, table, F.create_map(F.lit("p5"), F.lit(0.0))).collect()}  # no title score counts, none is left out
    got = {r.doc_id: r for r in pf.detect(cv, table).collect()}
    assert got == want
    monkeypatch.setattr(pf, "PART", 7)
    assert {r.doc_id: r for r in pf.detect(cv, table).collect()} == want

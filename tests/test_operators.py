"""Operators against brute force on small fixtures, hot keys included."""

import random

import pytest
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import search
from sparkfolio.operators import criteria as cr
from sparkfolio.operators import keywords as kw
from sparkfolio.operators import layout as lo
from sparkfolio.operators import matching as mt
from sparkfolio.operators import profiles as pf
from sparkfolio.operators import records as rec
from sparkfolio.operators import timeline as tl
from sparkfolio.operators import vectorjoin as vj
from sparkfolio.plans.report import quality_report
from sparkfolio.sources import listings as ls
from sparkfolio.sources.cv_json import read_cv_json
from sparkfolio.sources.words import parse_words

TEXT = """Marie Curie
Senior Data Engineer | Radium SA
marie@mail.example.org
06 12 34 56 78
59170 Croix

SUMMARY
Engineer with a long record, fond of pipelines

PROFESSIONAL EXPERIENCE
Jan 2019 – Mar 2020
Data Engineer - Radium SA
- Reduced costs by 20%
- Built pipelines in Python and Spark
2012 - 2014
Analyst | Polonium

EDUCATION
2008 - 2011
Ingénieur physique | Sorbonne

SKILLS
python, spark, docker, c++

PROJECTS
Atlas
- atlas of elements in scala
https://atlas.example.org

LANGUAGES
- Français
• Polonais
"""


@pytest.fixture(scope="module")
def record(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "")], "doc_id bigint, text string")
    return rec.enrich(rec.parse_text(df, as_of=(2026, 1)))


def test_record(record):
    r = record.filter("doc_id = 1").first()
    assert (r.header.name, r.header.title, r.header.location, r.header.postal_code) == ("Marie Curie", "Senior Data Engineer", "Croix", "59170")
    assert [(e.title, e.company, e.date_start, e.duration_months) for e in r.experience] == [
        ("Data Engineer", "Radium SA", "2019-01", 14), ("Analyst", "Polonium", "2012", 24)]
    assert [(e.degree, e.school) for e in r.education] == [("Ingénieur physique", "Sorbonne")]
    assert r.skills["languages"] == ["python", "c++", "scala"] and r.skills["mlops"] == ["docker"]
    assert r.projects[0].url == "https://atlas.example.org" and r.projects[0].stack == ["scala"]
    assert r.languages == ["Français", "Polonais"]
    assert r.experience_years == 3.2 and r.job_title == "Senior Data Engineer"


def test_empty_record(record):
    r = record.filter("doc_id = 2").first()
    assert r.header.name is None and r.experience == [] and r.word_count == 0 and r.job_title is None


def test_quality_report(record):
    r = quality_report(record, (2026, 1)).filter("doc_id = 1").first()
    assert r.career_gaps == ["2014–2019 : 5 an(s) sans activité détectée"]
    assert r.career_start_year == 2012 and r.most_recent_role == "Data Engineer @ Radium SA" and r.education_years == 3
    assert r.sections_missing == [] and not r.is_machine_readable
    empty = quality_report(record, (2026, 1)).filter("doc_id = 2").first()
    assert empty.sections_missing == ["experience", "education", "skills"] and empty.strength == 0


def test_records_survive_filters(record):
    """Filters on parsed columns must not be copied into the parsing expressions."""
    assert record.filter(F.size("experience") > 1).filter("sector is null or sector <> 'x'").count() == 1


def test_unknown_rule_and_generic(spark, record):
    rows = spark.createDataFrame([("p", 0, "x", "X", "no_such_rule", 100, True, [])], cr.CRITERION)
    out = cr.evaluate(record.withColumn("profile_id", F.lit("p")), rows).filter("doc_id = 1").collect()
    assert [(r.score, r.evidence) for r in out] == [(0, "Fonction 'no_such_rule' non implémentée")]
    generic = cr.evaluate(record.withColumn("profile_id", F.lit("other")), rows).filter("doc_id = 1")
    assert generic.count() == len(lx.GENERIC_CRITERIA)
    assert cr.totals(generic).first().total == 85.0


def test_contact_evidence_hides_values(record):
    r = record.filter("doc_id = 1").select(cr.rule_result("has_contact", F.array().cast("array<string>")).alias("r")).first().r
    assert r.score == 100 and "@" not in r.evidence and "06" not in r.evidence


@pytest.mark.parametrize("spec", [*lx.SECTOR_TEMPLATES.values(), *lx.PROFILE_OVERRIDES.values()])
def test_weights_sum_to_100(spec):
    assert sum(w for _, w, _ in spec) == 100 and all(c in lx.CRITERION_DEFS for c, _, _ in spec)


def test_missing_template_fails(spark):
    p = spark.createDataFrame([("x", "nowhere", ["k"])], "profile_id string, sector_key string, keywords array<string>")
    with pytest.raises(Exception, match="no criteria template"):
        cr.build_criteria(p, *cr.templates_frame(spark), cr.definitions_frame(spark)).collect()


def test_gaps_with_a_hot_key(spark):
    rnd = random.Random(7)
    rows = [(0 if i % 3 == 0 else rnd.randrange(1, 20), rnd.randrange(0, 400), i) for i in range(3000)]
    rows = [(k, s, s + rnd.choice([-20, 1, 2, 30]), i) for k, s, i in rows]
    want = []
    for key in {r[0] for r in rows}:
        mine = sorted([r for r in rows if r[0] == key], key=lambda r: (r[1], r[3]))
        want += [(key, a[2], b[1]) for a, b in zip(mine, mine[1:]) if b[1] - a[2] > 12]
    df = spark.createDataFrame(rows, "k int, s int, e int, o int")
    got = [tuple(r) for r in tl.gaps_by_key(df, "k", "s", "e", "o", 12).collect()]
    assert sorted(got) == sorted(want) and want


def test_first_seen_is_idempotent_and_keeps_order(spark):
    rows = [("u1", 2, "b"), ("u1", 1, "a"), ("u2", 5, "c")] * 50
    df = spark.createDataFrame(rows, "url string, o int, v string")
    once = ls.first_seen(df, ["url"], ["o"])
    assert sorted(map(tuple, once.collect())) == [("u1", 1, "a"), ("u2", 5, "c")]
    assert sorted(map(tuple, ls.first_seen(once, ["url"], ["o"]).collect())) == [("u1", 1, "a"), ("u2", 5, "c")]


def test_enrich_keywords_and_skills_from_text(spark, record):
    """Top words of the whole text; a record that states no skills gets those of its text, one with keeps its own."""
    text = "Keo Pen\n\nPROFESSIONAL EXPERIENCE\n2019 - 2021\nData engineer | Novalis\n- Pipelines of spark and docker, pipelines in python\n"
    df = spark.createDataFrame([(1, text), (2, "")], "doc_id bigint, text string")
    bare = rec.parse_text(df, as_of=(2026, 1)).withColumn("skills", F.create_map().cast("map<string,array<string>>"))
    r, empty = rec.enrich(bare).orderBy("doc_id").collect()
    assert r.skills_flat == ["docker", "python", "spark"] and empty.skills_flat == [] and empty.keywords == []
    assert r.keywords[0] == "pipelines" and {"novalis", "spark"} <= set(r.keywords) and not {"of", "and"} & set(r.keywords)
    r = record.filter("doc_id = 1").first()
    assert sorted(r.skills_flat) == ["c++", "docker", "python", "scala", "spark"] and 0 < len(r.keywords) <= 50


def test_lexicon_paths_agree(spark):
    texts = ["C++ and c# and .net, next.js", "machine learning machine learnings", "r&d in r", "asp.net x.net", "", "ci/cd ci / cd"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    lexicon = {"a": [".net", "c++", "c#", "next.js", "machine learning", "r", "asp.net", "ci/cd"]}
    frame = kw.lexicon_frame(spark, lexicon)
    rows = lambda d: sorted((r.doc_id, r.skill) for r in d.collect())
    slow = sorted((r.doc_id, r.term) for r in kw.matches_by_pattern(docs, "doc_id", "text", lexicon["a"]).collect())
    assert rows(kw.lexicon_matches(docs, "doc_id", "text", frame)) == slow
    assert rows(kw.lexicon_matches_by_join(docs, "doc_id", "text", frame)) == slow
    assert rows(kw.lexicon_matches(docs, "doc_id", "text", frame, max_literal=2)) == slow


def test_hot_search_is_cut_to_its_page(spark):
    listings = spark.range(2000).select(
        F.col("id").alias("listing_id"), F.lit("Data engineer").alias("title"), F.lit("59000 Lille").alias("location"),
        F.lit("python spark").alias("description"), F.concat(F.lit("u"), (F.col("id") % 7).cast("string")).alias("url"), F.lit("jooble").alias("source"))
    searches = spark.range(300).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("query_ord"), F.lit("data engineer").alias("query"), F.lit("59000 Lille").alias("place"),
        F.array(F.lit("59"), F.lit("lille")).alias("area"), F.lit(20).alias("page"))
    answers = mt.answer_searches(searches, listings)
    assert [r.listing_id for r in answers.orderBy("r").collect()] == list(range(20))
    first = mt.first_shown(mt.candidates(searches, answers, listings))
    assert first.groupBy("doc_id").count().select(F.min("count"), F.max("count")).first()[:] == (7, 7)


def test_listing_search(spark):
    """A page for each source, places without postal codes, regions, and long queries."""
    long = "data engineer for public health care and research"
    rows = [(i, "Data engineer", "59000 Lille", "adzuna") for i in range(30)] + [(100 + i, "Data engineer", "Lille, Nord", "france_travail") for i in range(5)]
    rows += [(200, long.title(), "Lyon", "jooble"), (201, "Data engineer", "Paris, Île-de-France", "jooble"), (202, "Data engineer", "75002 Paris", "jooble"), (203, "Data engineer", None, "jooble")]
    listings = spark.createDataFrame(rows, "listing_id long, title string, location string, source string")
    asks = [("data engineer", "59000 Lille"), (long, "69001 Lyon"), ("data engineer", "Ile-de-France")]
    searches = spark.createDataFrame(asks, "query string, place string").withColumn("area", search.search_area(F.col("place")))
    got = {}
    for r in mt.answer_searches(searches, listings).collect():
        got.setdefault((r.query, tuple(r.area)), []).append(r.listing_id)
    by_place = {k[1]: sorted(v) for k, v in got.items()}
    assert by_place[("59", "lille")] == [*range(20), *range(100, 105)]
    assert by_place[("69", "lyon")] == [200]
    assert [v for k, v in by_place.items() if "ile-de-france" in k] == [[201, 202]]


def test_listing_search_by_town_country_and_description(spark):
    """A town without a postal code meets coded listings, a country or unknown place all of them, same names elsewhere do not."""
    rows = [(1, "Data engineer", "59000 Lille", ""), (2, "Data engineer", "59 - LILLE", None), (3, "Data engineer", "Lille, Nord", ""), (4, "Data engineer", "75001 Paris, France", ""),
            (5, "Data engineer", None, ""), (6, "Data engineer", "93200 Saint-Denis", ""), (7, "Data engineer", "97400 Saint-Denis", ""), (8, "Data engineer", "Lyon, France", ""),
            (9, "Consultant", "59000 Lille", "A senior data engineer is wanted"), (0, "Consultant", "59000 Lille", "A metadata engineer")]
    listings = spark.createDataFrame(rows, "listing_id long, title string, location string, description string").withColumn("source", F.lit("jooble"))
    places = ["Lille", "59000 Lille", "Lille, France", "Saint-Denis", "93200 Saint-Denis", "France", "Atlantis", "Lyon", "Paris"]
    searches = spark.createDataFrame([("data engineer", p) for p in places], "query string, place string").withColumn("area", search.search_area(F.col("place")))
    answers = mt.answer_searches(searches, listings)
    got = {p: [] for p in places}
    for r in searches.select("place", "query", "area").join(answers, ["query", "area"]).orderBy("place", "r").collect():
        got[r.place].append(r.listing_id)
    everywhere = [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert got == {"Lille": [1, 2, 3, 9], "59000 Lille": [1, 2, 3, 9], "Lille, France": [1, 2, 3, 9], "Saint-Denis": [6, 7], "93200 Saint-Denis": [6],
                   "France": everywhere, "Atlantis": everywhere, "Lyon": [8], "Paris": [4]}


def test_long_terms_in_both_paths(spark):
    terms = ["natural language processing for finance", "machine learning (ml)", "(ml)"]
    texts = ["Natural Language Processing for Finance", "machine learning (ml) here", "machine learning (ml)x", "machine learning (ml)", "natural language processing"]
    docs, frame = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), kw.lexicon_frame(spark, {"a": terms})
    rows = lambda d: sorted((r.doc_id, r.skill) for r in d.collect())
    want = [(0, terms[0]), (1, terms[2]), (1, terms[1]), (3, terms[2]), (3, terms[1])]
    slow = sorted((r.doc_id, r.term) for r in kw.matches_by_pattern(docs, "doc_id", "text", terms).collect())
    assert rows(kw.lexicon_matches(docs, "doc_id", "text", frame)) == rows(kw.lexicon_matches(docs, "doc_id", "text", frame, max_literal=0)) == slow == sorted(want)


def test_detect_profile(spark, record):
    catalogue = [pf.Profile("a", "A", "Data engineer", [], ["python", "spark"]), pf.Profile("b", "B", "Nurse", [], ["soins"])]
    d = {r.doc_id: r for r in pf.detect(record, catalogue).collect()}
    assert (d[1].profile_id, d[1].confidence) == ("a", 0.6) and [x.id for x in d[1].alternatives] == ["b"]
    assert (d[2].profile_id, d[2].confidence) == ("non_detecte", 0.0) and [x.id for x in d[2].alternatives] == ["a", "b"]


def test_vector_paths_agree(spark):
    rnd = random.Random(3)
    vec = lambda n: [(i, [rnd.uniform(-1, 1) for _ in range(4)]) for i in range(n)]
    a, b = spark.createDataFrame(vec(60), "id long, vector array<double>"), spark.createDataFrame(vec(9), "phrase long, vector array<double>")
    rows = lambda d: sorted((r.id, r.phrase, round(r.sim, 9)) for r in d.collect())
    assert rows(vj.similar_pairs(a, b, 0.4)) == rows(vj.similar_pairs(a, b, 0.4, max_broadcast=2))
    o = a.select((F.col("id") % 3).alias("owner"), "vector")
    best = lambda d: sorted((r.owner, r.phrase, round(r.sim, 9)) for r in d.collect())
    assert best(vj.best_per_phrase(o, b)) == best(vj.best_per_phrase(o, b, max_broadcast=2))


def test_line_anchor_does_not_drift(spark):
    """Small steps must not chain past the tolerance of a line's first word."""
    rows = [(1, 0, f"w{i}", float(i), float(i) + 1, top, top + 10, 10.0, "F") for i, top in enumerate([10.0, 12.0, 14.0, 16.0, 18.0])]
    w = spark.createDataFrame(rows, "doc_id bigint, page int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string")
    got = {r.top: r.anchor for r in lo.line_anchors(w).collect()}
    assert got == {10.0: 10.0, 12.0: 10.0, 14.0: 14.0, 16.0: 14.0, 18.0: 18.0}


def test_two_column_words(spark):
    rows = []

    def put(text, x, top, size=10.0, font="F"):
        for k, part in enumerate(text.split()):
            rows.append((1, 0, part, x + 20.0 * k, x + 20.0 * k + 15, float(top), top + 10.0, size, font))

    put("Keo", 50, 20, 22.0)
    put("PEN", 310, 24, 18.0)
    for i, line in enumerate(["PROFESSIONAL EXPERIENCE", "2019 - 2021", "Data engineer | Novalis", "- reduced costs by 20%"]):
        put(line, 50, 300 + 20 * i)
    for i, line in enumerate(["SKILLS", "python docker kubernetes terraform spark", "LANGUAGES", "- Anglais"]):
        put(line, 310, 300 + 20 * i)
    put("footer", 50, 800)
    w = spark.createDataFrame(rows, "doc_id bigint, page int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string")
    r = parse_words(w).first()
    assert r.layout_detected == "two_columns" and [e.title for e in r.experience] == ["Data engineer"]
    assert r.languages == ["Anglais"] and r.skills["languages"] == ["python"]


def test_cv_json_bad_rows(spark):
    raw = spark.createDataFrame([(1, '```json\n{"header": {"name": "Ada"}, "languages": [{"l": "", "n": "English"}, "Latin"]}\n```'),
                                 (2, "no answer"), (3, '{"header": ')], "doc_id bigint, raw string")
    ok, bad = read_cv_json(raw, "raw")
    r = ok.collect()
    assert [(x.doc_id, x.header.name, x.languages, x.extraction_confidence) for x in r] == [(1, "Ada", ["English", "Latin"], 0.95)]
    assert sorted(x.doc_id for x in bad.collect()) == [2, 3]


def test_stream_reads_folders_and_drops_late_rows(spark, tmp_path):
    from sparkfolio.streaming import jobs

    rows = [("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 11:00:00", "a", 3.0), ("2024-01-02 10:00:00", "a", 5.0)]
    df = spark.createDataFrame(rows, "t string, g string, v double").select(F.col("t").cast("timestamp").alias("ts"), "g", "v")
    df.repartition(2).write.parquet(str(tmp_path / "events.parquet"))
    stream = jobs.file_stream(spark, str(tmp_path / "events*.parquet"), df.schema)
    out = jobs.run_available(jobs.windowed_figures(stream, "g", "v"), "test-figures").collect()
    assert [(str(r.start), r.n, r.avg_value) for r in out] == [("2024-01-01 00:00:00", 2, 2.0)]


def test_analysis_log_appends_by_day(spark, tmp_path):
    from sparkfolio.sources import logs

    row = spark.sql("select timestamp'2024-01-01 10:00:00' ts, 'p' profile_id, 's' sector, 'ocr' extraction_method, 0.5D detection_confidence, "
                    "70D profile_strength_score, 300D word_count, 12D latency_ms")
    path = str(tmp_path / "log")
    logs.append_analysis_log(row, path)
    logs.append_analysis_log(row, path)
    assert spark.read.parquet(path).filter("day = '2024-01-01'").count() == 2


def test_embedding_hook(spark):
    from sparkfolio.functions.embedding import embedding_udf, hashed_embedding

    embed = embedding_udf(lambda: lambda texts: [[float(len(t)), 1.0] for t in texts], batch=2)
    df = spark.createDataFrame([("abc",), (None,), ("python spark",)], "text string")
    assert sorted(r.e for r in df.select(embed(F.col("text")).alias("e")).collect()) == [[0.0, 1.0], [3.0, 1.0], [12.0, 1.0]]
    v = hashed_embedding(df.filter("text = 'python spark'"), "text", "v", 32).first().v
    assert len(v) == 32 and abs(sum(x * x for x in v) - 1) < 1e-9


def test_csv_report_round_trip(spark, tmp_path):
    from sparkfolio.sources import logs

    df = spark.createDataFrame([("a", 1), ("é, b", 2)], "name string, score int")
    logs.write_csv_report(df, str(tmp_path / "r"))
    assert sorted(map(tuple, logs.read_csv_report(spark, str(tmp_path / "r"), "name string, score int").collect())) == [("a", 1), ("é, b", 2)]


def test_profile_catalogue_round_trip(spark, tmp_path):
    from sparkfolio.sources.profiles import SCHEMA, profile_list, read_profiles

    spark.createDataFrame([("a", "btp", "BTP", "Maçon", ["maçon"], ["béton"])], SCHEMA).write.parquet(str(tmp_path / "p.parquet"))
    assert profile_list(read_profiles(spark, str(tmp_path / "p.parquet")))[0].keywords == ["béton"]


def test_project_address_is_no_metric(spark):
    text = "PROJECTS\nAtlas\n- maps\nhttps://atlas.example.org/32286\n+ gain 20 %\nsee https://atlas.example.org/9 for 45000 clients"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    (p,) = rec.parse_text(df, fields=["projects"]).first().projects
    assert p.url == "https://atlas.example.org/32286"
    assert p.metrics == ["+ gain 20 %", "see https://atlas.example.org/9 for 45000 clients"]


def test_keyword_rules_lower_a_text_once(spark):
    df = spark.createDataFrame([("Le CACES et le Permis", ["caces", "PERMIS", "usine"])], "raw_text string, kws array<string>")
    found = df.select(cr._found(F.col("kws"), F.lower("raw_text")).alias("f"))
    assert found.first().f == ["caces", "PERMIS"]
    assert "contains(lower(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()  # inside the lambda it would run for each keyword


def test_reading_order(spark):
    rows = [(1, p, a, c, "t" * 9) for p in (1, 0) for a, c in ((30.0, "right"), (10.0, "full"), (30.0, "left"), (20.0, "right"))] + [(2, 0, 5.0, "full", "x")]
    placed = lo.reading_order(spark.createDataFrame(rows, "doc_id long, page int, anchor double, col string, text string"))
    got = [(r.page, r.anchor, r.col) for r in placed.filter("doc_id = 1").orderBy("pos").collect()]
    assert got == [(p, a, c) for p in (0, 1) for a, c in ((10.0, "full"), (30.0, "left"), (20.0, "right"), (30.0, "right"))]
    assert [r.pos for r in placed.filter("doc_id = 2").collect()] == [1]
    assert placed.columns == ["doc_id", "page", "anchor", "col", "pos"]


def test_matching_evaluates_records_once(spark, monkeypatch):
    """A record's long expressions are read for matching once, and a keyword of several candidates is looked for once, in rank order."""
    from pyspark.sql import functions as F

    from sparkfolio.operators import matching as mt

    written = []
    plain = mt.persisted
    monkeypatch.setattr(mt, "persisted", lambda df, name: written.append(name) or plain(df, name))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    cv = spark.createDataFrame([(1, "welder", ["steel"], None, None, "Lyon", "Steel and iron welder", {"skills": "steel"}), (2, "welder", [], None, None, "Lyon", "Tin", {})],
                               "doc_id long, job_title string, skills_flat array<string>, sector string, postal_code string, location string, raw_text string, sections map<string,string>")
    cv = cv.withColumn("raw_text", counted.asNondeterministic()("raw_text"))
    jobs = spark.createDataFrame([(i, "welder", "Lyon", f"iron steel brass iron {w}", f"u{i}", "adzuna") for i, w in enumerate(["zinc", "tin", "zinc"])],
                                 "listing_id long, title string, location string, description string, url string, source string")
    got = mt.scored_candidates(cv, jobs, embed=None).collect()
    assert written[0] == "records" and seen.value == 2
    assert len(got) == 6 and all(list(r.matched) == (["iron", "steel"] if r.doc_id == 1 else ["tin"] if r.listing_id == 1 else []) for r in got)
    assert all(len(r.matched) + len(r.missing) == 4 for r in got)


def test_words_move_once_to_their_lines(spark):
    schema = "doc_id long, page int, text string, x0 double, x1 double, top double, bottom double, size double, fontname string"
    rows = []
    for page in (0, 1):
        for i in range(12):
            rows += [(1, page, f"l{i}", 50.0, 60.0, 100.0 + 20 * i, 110.0 + 20 * i, 10.0, None), (1, page, f"r{i}", 300.0, 420.0, 102.0 + 20 * i, 112.0 + 20 * i, 12.0, "X-Bold"),
                     (1, page, f"m{i}", 120.0, 130.0, 101.0 + 20 * i, 111.0 + 20 * i, 10.0, None)]
    rows += [(1, 0, "nowhere", 60.0, 70.0, None, None, 10.0, None), (1, None, "loose", 60.0, 70.0, 110.0, 120.0, 10.0, None), (2, 0, "alone", None, None, 10.0, 20.0, None, None)]
    words = spark.createDataFrame(rows, schema)
    lines = lo.assemble_lines(words)
    assert lines._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.doc_id, r.page, r.anchor, r.col): (r.text, r.size, r.bold, r.x0, r.top) for r in lines.collect()}
    want = {(2, 0, 10.0, "full"): ("alone", 10.0, False, None, 10.0)}
    for page in (0, 1):
        for i in range(12):
            want[1, page, 100.0 + 20 * i, "left"] = (f"l{i} m{i}", 10.0, False, 50.0, 100.0 + 20 * i)
            want[1, page, 100.0 + 20 * i, "right"] = (f"r{i}", 12.0, True, 300.0, 102.0 + 20 * i)
    assert got == want
    head = {tuple(r) for r in lo.top_lines(lines).collect()}
    by_hand = {tuple(r) for r in lines.join(lo.head_threshold(lines), "doc_id").filter("top <= head_top").select("doc_id", "page", "col", "anchor").collect()}
    assert head == by_hand and len(head) == 1 + 6
    docs = lo.document_lines(words)
    assert docs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    doc = {r.doc_id: r for r in docs.collect()}
    assert [x.text for x in doc[1].lines] == [t for page in (0, 1) for side in ("l{0} m{0}", "r{0}") for t in map(side.format, range(12))]
    assert doc[1].layout == "two_columns" and doc[1].body_size == 10.0 and doc[2].layout == "single_column"


def test_ordered_distinct_words_of_odd_rows(spark, tmp_path):
    """As the SQL has it: keys without words have no row, texts of a repeated key count as one, a vertical tab is no blank."""
    import duckdb

    from sparkfolio.catalog import load

    runs, sql = (x["u7_ordered_distinct"] for x in load())
    rows = [(1, "b a b\tc"), (2, None), (3, ""), (4, " \u00a0\n"), (5, "x\x0by x\x0by \x85 z"), (6, "k l k m"), (6, "k l n m o o p"), (None, "r s"), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(sql.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    got = [tuple(r) for r in runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and (6, "k l n m o p") in got and len(got) == 4


def test_records_that_ask_the_same_are_shown_the_same(spark, monkeypatch):
    """What is shown is found once for each ask, no vector or keyword is written for a pair, and the scores are those of the pairs one by one."""
    from sparkfolio.functions.embedding import hashed_embedding
    from sparkfolio.operators import semantic as sm

    plain, written = mt.persisted, {}

    def keep(df, name):
        out = plain(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(mt, "persisted", keep)
    embed = lambda rows, text, out: hashed_embedding(rows, text, out, 16)
    towns = ["59000 Lille", "69001 Lyon"]
    rows = [(i, ["welder", "baker"][i % 2], towns[i // 2 % 2], ["Steel and iron welder", "Bread and tin", None, "zinc brass wanted"][i % 4]) for i in range(120)]
    rows += [(None, "welder", towns[0], "steel"), (500, "welder", towns[0], "steel"), (500, "baker", towns[1], "tin"), (501, "welder", "Atlantis", "steel tin"), (502, "pilot", towns[0], "x")]
    cv = spark.createDataFrame(rows, "doc_id long, job_title string, location string, raw_text string").select(
        "*", F.array().cast("array<string>").alias("skills_flat"), F.lit(None).cast("string").alias("sector"), F.lit(None).cast("string").alias("postal_code"),
        F.create_map(F.lit("skills"), F.lit("x")).alias("sections"))
    jobs = spark.createDataFrame([(i, ["welder", "baker"][i % 2], towns[i // 2 % 2], f"iron steel brass tin {w} welder", f"u{i % 9}", ["adzuna", "jooble"][i % 3 == 0])
                                  for i, w in enumerate(["zinc", "tin", "bread", ""] * 6)],
                                 "listing_id long, title string, location string, description string, url string, source string")
    got = mt.scored_candidates(cv, jobs, embed=embed)
    asked, pairs = got.filter("doc_id < 500").select("doc_id").distinct().count(), got.filter("doc_id < 500").count()
    assert asked == 120 and pairs > 5 * written["shown"][0]
    asks = mt.settled(mt.search_table(cv.filter("doc_id is not null")), jobs)
    first = mt.first_shown(mt.candidates(asks, mt.answer_searches(asks, jobs), jobs))
    want = mt.score_candidates(cv, first, jobs, sm.pair_similarity(first, cv, jobs, embed))
    as_rows = lambda df: sorted((r.doc_id, r.listing_id, r.source, tuple(r.seen_ord), r.shown, r.keyword, r.structure, round(r.semantic, 9), r.overall, tuple(r.matched), tuple(r.missing))
                                for r in df.collect())
    assert as_rows(got) == as_rows(want)

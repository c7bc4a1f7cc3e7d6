"""Expressions on written-out values with known answers."""

from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import contact, dates, search, skills
from sparkfolio.functions import text as tx
from sparkfolio.functions.arrays import ranked_terms, terms
from sparkfolio.functions.vectors import clipped_cosine


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(
        f"{k} {'array<string>' if isinstance(v, list) and (not v or isinstance(v[0], str)) else 'array<double>' if isinstance(v, list) else 'string'}"
        for k, v in values.items()))
    return row.select(expr.alias("r")).first().r


@pytest.mark.parametrize("text,expected", [
    ("2020 - 2023", ("2020", "2023", 36, False)),
    ("Jan 2019 – Mar 2020", ("2019-01", "2020-03", 14, False)),
    ("Jan 2021 – Present", ("2021-01", "present", 60, True)),
    ("2022 – en cours", ("2022", "present", 48, True)),
    ("2023", ("2023", None, None, False)),
    ("Stage de 6 mois", (None, None, 6, False)),
    ("Mission de 2 ans", (None, None, 24, False)),
    ("janvier 2020 - mars 2021", ("2020-01", "2021-03", 14, False)),
    ("fév 2020 - juin 2020", ("2020-02", "2020-06", 4, False)),
    ("Promotions 2018, 2019 et 2021", ("2018", "2021", 36, False)),
    ("Python, Docker, Kubernetes", (None, None, None, False)),
])
def test_date_range(spark, text, expected):
    assert tuple(one(spark, dates.date_range(F.col("t"), (2026, 1)), t=text)) == expected


@pytest.mark.parametrize("text,expected", [("2015-01", (2015, 1)), ("2015", (2015, 1)), ("06/2010", (2010, 6)),
                                           ("present", None), ("soon", None), ("1/2/2010", None)])
def test_year_month(spark, text, expected):
    got = one(spark, dates.year_month(F.col("t")), t=text)
    assert (tuple(got) if got else None) == expected


@pytest.mark.parametrize("text,years", [("Engineer 2018 - 2020 and 2020 - 2022", 4.0), ("2024 - present", 2.0), ("no years", None),
                                        ("1950 - 1960", None)])
def test_years_from_spans(spark, text, years):
    assert one(spark, dates.years_from_spans(F.col("t"), 2026), t=text) == years


@pytest.mark.parametrize("text,low,dec", [
    ("45000 - 60000 EUR", 45000.0, 45000.0), ("Negotiable", None, None), ("45 000 €", 45000.0, 45.0),
    ("Mensuel de 2200.0 Euros à 2500.0 Euros", 22000.0, 2200.0)])
def test_salaries(spark, text, low, dec):
    assert one(spark, contact.salary_min_thousands(F.col("t")), t=text) == low
    assert one(spark, contact.salary_min_decimal(F.col("t")), t=text) == dec


@pytest.mark.parametrize("text,code", [("59170 Croix", "59"), ("59", "59"), ("974", "974"), ("Hauts-de-France", None), ("1234", None)])
def test_department(spark, text, code):
    assert one(spark, contact.department_code(F.col("t")), t=text) == code


@pytest.mark.parametrize("text,city,code", [
    ("59170 Croix", "Croix", "59170"), ("Croix, 59170", "Croix", "59170"), ("42000 Saint-Étienne", "Saint-Étienne", "42000"),
    ("nothing here", None, None)])
def test_postal_city(spark, text, city, code):
    assert one(spark, contact.city(F.col("t")), t=text) == city
    assert one(spark, contact.postal_code(F.col("t")), t=text) == code


def test_street_does_not_win(spark):
    null = F.lit(None).cast("string")
    got = one(spark, contact.cascade_location(null, null, F.col("t"), null, null), t="12 rue Jean Jaurès, 59170 Croix")
    assert tuple(got) == ("Croix", "59170")


@pytest.mark.parametrize("text,hit", [("uses C++ daily", True), ("C++", True), ("c++x", False), ("développé en go", True), ("été", False)])
def test_symbol_terms(spark, text, hit):
    got = one(spark, skills.grams_in(F.col("t"), lx.SKILLS["languages"]), t=text)
    assert bool(set(got)) == hit, got


def test_terms_need_word_borders(spark):
    got = one(spark, skills.grams_in(F.col("t"), skills.all_skills(lx.SKILLS)), t="javascript and machine learning, ci/cd; next.js. Java")
    assert sorted(got) == ["ci/cd", "java", "javascript", "machine learning", "next.js"]


@pytest.mark.parametrize("title,query", [
    ("Senior ML Engineer", "ML Engineer"), ("Conseiller de vente Sandro Paris Nord", "Conseiller de vente"),
    ("ML Engineer ACME Corp Europe", "ML Engineer ACME Corp"), ("Boulanger", "Boulanger")])
def test_plain_title(spark, title, query):
    assert one(spark, search.plain_title(F.col("t")), t=title) == query


def test_synonyms_first_group_wins(spark):
    assert one(spark, search.synonym_queries(F.col("t")), t="Vendeur en magasin")[0] == "conseiller de vente"
    assert one(spark, search.synonym_queries(F.col("t")), t="Chauffeur")[0] == "conducteur"
    assert one(spark, search.synonym_queries(F.col("t")), t="Notaire") == []


@pytest.mark.parametrize("raw,skill", [("use Python", "python"), ("Develop data models", "data models"), ("data", None),
                                       ("apply four words are many", None), ("", None)])
def test_normalise_skill(spark, raw, skill):
    assert one(spark, skills.normalise_skill(F.col("t")), t=raw) == skill


@pytest.mark.parametrize("skill,category", [("tensorflow", "ml"), ("docker", "mlops"), ("aws", "cloud"), ("c++", "languages"),
                                            ("data mining", "data"), ("welding", "other"), ("r", "languages")])
def test_categorise_skill(spark, skill, category):
    assert one(spark, skills.categorise_skill(F.col("t")), t=skill) == category


@pytest.mark.parametrize("a,b,sim", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], 0.0),
                                     ([0.0, 0.0], [1.0, 0.0], 0.0)])
def test_cosine(spark, a, b, sim):
    assert one(spark, clipped_cosine(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(sim)


def test_title_case(spark):
    assert one(spark, tx.title_case(F.col("t")), t="jean-pierre d'arc") == "Jean-Pierre D'Arc"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from(["a", "b", "cc", "dd", "e", "fé"]), max_size=30), st.integers(1, 5))
def test_ranked_terms_like_counter(spark, tokens, k):
    got = one(spark, terms(ranked_terms(F.col("t"), k)), t=tokens)
    assert got == [w for w, _ in Counter(tokens).most_common(k)]


def test_blanks_are_cleaned_as_by_plain_patterns(spark):
    """Only what needs it is replaced: single blanks are no match, and a text without double blanks, tabs or lines is not searched by pattern."""
    import re

    from pyspark.sql import functions as F

    from sparkfolio.functions import text as tx

    texts = ["", " ", "a b", "a  b\t c \t\td", "\t", "a\n\n\n\nb  c", "\n\n\na\n\n", " a\u00a0 b ", "x\n \n\n y", None, "a\t\n\n\n \nb"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tx.clean_blanks(F.col("t")).alias("c"), tx.words(F.col("t")).alias("w"))
    for r in rows.collect():
        if r.t is None:
            assert r.c is None and r.w is None
            continue
        assert r.c == re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", r.t)).strip(" \t\n\r\f\x0b")
        assert r.w == [x for x in re.split(r"[ \t\n\u00a0]+", r.t) if x]
    plan = spark.range(1).select(tx.words(F.col("id").cast("string")).alias("w"), tx.one_blank(F.lit("a b").cast("string")).alias("b"))
    assert "translate(" not in plan._jdf.queryExecution().analyzed().toString()

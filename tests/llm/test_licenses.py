"""License scans: base columns by brute force, labels of whole and damaged notices."""

import re

import pytest

from sparkfolio.llm import licenses
from sparkfolio.llm.queries import QUERIES
from tests.conftest import SF

PHRASES = {"cc-by": ["cc", "by"], "gpl": ["general", "public", "license"], "reserved": ["all", "rights", "reserved"]}


def brute(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
    at = [(i, k) for k, p in PHRASES.items() for i in range(len(w)) if w[i:i + len(p)] == p]
    places = [i for i, _ in at]
    return len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({k for _, k in at}))


def base(r):
    return r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op2_license_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    assert all(base(r) == brute(texts[r.doc_id]) for r in rows)
    assert any(r.n_base for r in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    rows = [(1, None), (1, None), (2, ""), (None, "CC BY cc-by, CC\nBY"), (3, "cc by " * 3000 + "general public license"), (4, "cc cc by by ÉCC BY"),
            (5, "All rights"), (5, "ALL RIGHTS reserved")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, label string, row int").repartition(3)
    got = sorted(((-1 if r.doc_id is None else r.doc_id, *base(r)) for r in licenses.license_digest(df).collect()), key=str)
    assert got == sorted(((-1 if i is None else i, *brute(t)) for i, t in rows), key=str)
    assert licenses.license_digest(df.limit(0)).count() == 0


@pytest.mark.parametrize("template", [t for t in licenses.NOTICES if len(t.text.split()) > 25], ids=lambda t: t.label)
def test_damaged_notices(spark, template):
    w = template.text.split()
    inserted = w[:12] + ["extra"] + w[12:]
    missing = w[:12] + w[13:]
    df = spark.createDataFrame([(0, "x y z " + " ".join(w) + " end"), (1, " ".join(inserted)), (2, " ".join(missing)), (3, " ".join(w[:len(w) // 2]))],
                               "doc_id long, text string")
    labels = {r.doc_id: r.labels.split(",") for r in licenses.license_digest(df, (template,)).collect()}
    assert [template.label in labels[i] for i in range(4)] == [True, True, True, False]
    (span,) = licenses.scan(df.filter("doc_id = 0"), (template,)).collect()
    assert span.start == 3 and span.score == 1.0


def test_native_plan(spark):
    plan = licenses.license_digest(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)

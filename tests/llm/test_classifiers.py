"""Toxicity and quality: accuracy on held-out rows, edges, and the compiled rules against their plain evaluation."""

import numpy as np
import pytest

from sparkfolio.llm import rules, toxicity
from sparkfolio.llm.queries import QUERIES
from sparkfolio.llm.training import labelled_sample

SF = "/root/testdata/sf0.01"  # held-out rows of the smallest tables are few


def auc(scores, labels):
    s, y = np.array(scores), np.array(labels)
    pos, neg = s[y == 1], s[y == 0]
    return ((pos[:, None] > neg[None, :]).mean() + (pos[:, None] == neg[None, :]).mean() / 2)


@pytest.mark.parametrize("name,label,at", [("op3_toxicity", "toxic", 0.7), ("op10_quality_rules", "quality", 0.3)])
def test_held_out(spark, name, label, at):
    y = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES[name](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= at) for r in rows)
    held = [r for r in rows if r.held_out and y.get(r.doc_id) is not None]
    assert auc([r.score for r in held], [y[r.doc_id] for r in held]) > 0.9
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.9


def test_toxicity_edges(spark):
    rows = [(1, "you vile worm", 1), (2, "a kind word", 0), (3, "vile worm", 1), (4, "kind people", 0), (5, None, 0), (6, "", 1)] * 5
    sample = spark.createDataFrame(rows, "doc_id long, text string, y int")
    model = toxicity.fit_toxicity(sample)
    docs = spark.createDataFrame([(1, "vile worm " * 50_000, 9.0), (1, "kind", 9.0), (None, None, 9.0), (2, "", None)], "doc_id long, text string, score double")
    got = [r.score for r in toxicity.with_toxicity(docs, model).collect()]
    assert got[0] > 0.5 > got[1] and got[2] == got[3] and all(0 <= x <= 1 for x in got)
    assert toxicity.with_toxicity(docs.limit(0), model).count() == 0
    one_class = toxicity.fit_toxicity(sample.filter("y = 1"))
    assert toxicity.with_toxicity(docs, one_class).first().score > 0.5
    assert toxicity.with_toxicity(docs, toxicity.fit_toxicity(sample.limit(0))).first().score == 0.5


def test_labels_of_an_id(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, None), (None, 1)], "doc_id long, quality int")
    from pyspark.sql import functions as F

    assert sorted((r.doc_id, r.y) for r in labelled_sample(docs, labels, "quality", F.lit(True)).collect()) == [(1, 1), (2, 0)]


def test_quality_edges(spark):
    good, bad = "A plain sentence stands here. Another one follows it, and ends.", "$$ ## 12 %% 12 %% 12 @@"
    sample = spark.createDataFrame([(i, (good, bad)[i % 2] + f" {i}", 1 - i % 2) for i in range(60)], "doc_id long, text string, y int")
    model = rules.fit_quality(sample)
    docs = spark.createDataFrame([(1, good * 3000), (1, bad), (None, None), (2, ""), (3, "\x00 \n")], "doc_id long, text string")
    got = [r[0] for r in rules.with_stats(docs).select(model.score_column()).collect()]
    assert got[0] > got[1] and got[2] == got[3] and all(x is not None and 0 <= x <= 1 for x in got)
    assert rules.with_stats(docs.limit(0)).select(model.score_column()).count() == 0
    for empty in (sample.limit(0), sample.filter("y = 1")):
        assert 0 <= rules.with_stats(docs).select(rules.fit_quality(empty).score_column()).first()[0] <= 1

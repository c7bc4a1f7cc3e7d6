"""Each stage of the pipeline against a plain version, on what the stage before it kept."""

import numpy as np
import pytest

import corpus_pipeline
from sparkfolio.session import persisted
from tests.conftest import SF
from tests.llm import test_mixing as plain_mixing
from tests.llm import test_setjoin, test_suffixes


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out.append((docs, persisted(stage(spark, docs, SF), f"test-{name}")))
        docs = out[-1][1]
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_quality(outputs, spark):
    before, after = (rows(x) for x in outputs[0])
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert after and all(after[i] == before[i] for i in after)
    known = [i for i in before if y.get(i) is not None]
    assert np.mean([(i in after) == bool(y[i]) for i in known]) > 0.9


def test_near_duplicates(outputs):
    before, after = (rows(x) for x in outputs[1])
    want = {i for i, _, component in test_setjoin.brute([(i, r.text) for i, r in sorted(before.items())]) if i == component}
    assert set(after) == want and all(after[i] == before[i] for i in after)


def test_repeats(outputs):
    before, after = (rows(x) for x in outputs[2])
    ids = sorted(before)
    assert sorted(after) == ids
    import hashlib

    for i, (n, gone, _, digest) in zip(ids, test_suffixes.brute([before[i].text for i in ids], 400)):
        assert after[i].n_chars == len(after[i].text)
        if gone == 0 or hashlib.sha256(after[i].text.encode()).hexdigest() != digest:
            assert after[i].text == before[i].text or gone  # a cut inside a character is mended by leaving the character out
        assert len((before[i].text or "").encode()) - len(after[i].text.encode()) <= gone + 6 * (gone > 0)


def test_mixing(outputs):
    before, after = (rows(x) for x in outputs[3])
    assert set(after) < set(before) and all(after[i] == before[i] for i in after)


def test_mixing_keeps_the_drawn_ids(outputs, spark):
    before, after = (rows(x) for x in outputs[3])
    assert set(after) == plain_mixing.plain_kept(spark, [(i, r.text, r.lang, r.source) for i, r in before.items()])


def test_encoding(outputs):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.queries.piece_model())
    before, after = (rows(x) for x in outputs[4])
    assert sorted(after) == sorted(before)
    for i, r in after.items():
        assert r.ids == sp.encode(before[i].text or "") and r.n_tokens == len(r.ids)
        assert r.exact == (sp.decode(r.ids) == (before[i].text or ""))


def test_run_on_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, an extra column, and no documents at all."""
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, "One two three four five six.", "en", "a", 28, "x"), (1, "One two three four five six.", "en", "a", 28, "x"), (2, "", "de", "b", 0, None),
                                  (None, None, None, None, None, None), (3, "word " * 30_000, "en", "a", 150_000, "y")],
                                 "doc_id long, text string, lang string, source string, n_chars long, key string")
    for at, d in (("some", docs), ("none", docs.limit(0))):
        d.write.parquet(f"{tmp_path}/{at}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{at}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{at}")
        assert got.columns == ["doc_id", "lang", "source", "ids", "n_tokens", "exact"]
        assert got.count() <= d.count()


def test_near_duplicates_of_odd_rows(spark, tmp_path):
    """One id with two texts, texts without an id, repeated rows and rows without words: exactly these rows stay."""
    body = " ".join(f"w{i}" for i in range(60))
    near, other = body.replace("w59", "x"), " ".join(f"v{i}" for i in range(60))
    given = [(3, body), (5, near), (5, other), (5, other), (None, other), (None, "lone words of one two"), (None, "lone words of one two"), (None, "lone words of one two"),
             (7, None), (7, None), (None, ""), (8, "few words"), (9, "few words")]
    spark.createDataFrame([(i, t, "en", f"s{k}", k) for k, (i, t) in enumerate(given)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/docs")
    got = corpus_pipeline.near_duplicates(spark, spark.read.parquet(f"{tmp_path}/docs"), "").collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    stay = [(3, body), (5, other), (None, "lone words of one two"), (7, None), (7, None), (None, ""), (8, "few words")]
    assert sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(stay, key=key)
    assert len({r.n_chars for r in got}) == len(got)  # rows of the table, none of them twice

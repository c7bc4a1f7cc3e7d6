"""The encoder and decoder against the library, on hard texts and on arbitrary ids."""

import random

import pytest

from sparkfolio.llm.pieces import Codec, Vocabulary, decode_ids, encode_and_compare, encode_texts, token_digests

P = pytest.importorskip("public_tokenizers")
SP = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def both():
    path = P.path("piece_bpe_32k.model")
    return Codec(Vocabulary.from_model(path)), SP.SentencePieceProcessor(model_file=path)


HARD = ["", " ", "  ", " " * 40, "a", " a", "a ", "a  b", "   x   y", "\n", "\n\n a\n", "\t tab", "▁", "a▁b ▁▁", "<s></s><unk>", "<0x41>",
        "naïve café", "日本語のテキスト", "😀 ok 👩‍👩‍👧", "́x", "0" * 300, "a" * 1000, "=" * 70, "\x00x", "\r\n", "x y", "Erron,the.of\nAnd"]


def test_hard_texts(both):
    c, sp = both
    for t in HARD:
        assert c.encode(t) == sp.encode(t), t
        assert c.decode(sp.encode(t)) == sp.decode(sp.encode(t)), t


def test_random_texts(both):
    c, sp = both
    r = random.Random(1)
    abc = ["the", "ing", " ", "  ", "\n", "é", "ß", "ción", "a", "b", "t", "h", "e", ".", ",", "1", "日", "😀", "▁", "tion", "er", "\t", "S", "-", "=", "://"]
    for _ in range(4000):
        t = "".join(r.choice(abc) for _ in range(r.randint(1, 30)))
        assert c.encode(t) == sp.encode(t), repr(t)
        assert c.decode(c.encode(t)) == sp.decode(sp.encode(t)), repr(t)


def test_real_texts(both, spark):
    c, sp = both
    from tests.conftest import SF

    texts = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for t in texts:
        assert c.encode(t) == sp.encode(t)
        assert c.decode(sp.encode(t)) == sp.decode(sp.encode(t))


def test_any_ids(both):
    c, sp = both
    r = random.Random(2)
    for _ in range(2000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), r.randrange(3)]) for _ in range(r.randint(0, 12))]
        assert c.decode(ids) == sp.decode(ids), ids


def test_columns(spark, both):
    import hashlib

    c, sp = both
    rows = [(1, "one two", "x"), (1, "one two", "x"), (None, None, None), (2, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode_ids(encode_texts(df, c.vocabulary), c.vocabulary).collect()
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=str) == sorted(
        ((i, sp.encode(t or ""), t or "") for i, t, _ in rows), key=str)
    d = {r.doc_id: r for r in token_digests(df, c.vocabulary).collect()}
    assert d[1].n_tokens == len(sp.encode("one two")) and d[2].n_tokens == 0
    assert d[1].ids_sha256 == hashlib.sha256(",".join(map(str, sp.encode("one two"))).encode()).hexdigest()
    assert d[1].decoded_sha256 == hashlib.sha256(b"one two").hexdigest() and d[None].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    assert token_digests(df.limit(0), c.vocabulary).count() == 0


def test_encoding_and_decoding_share_a_worker(spark, both):
    """Chained, the two steps held two Python workers a core; few kept segments change no result."""
    import corpus_pipeline
    from sparkfolio.llm.pieces import FEW_SEGMENTS, MAX_SEGMENTS

    c, sp = both
    texts = [*HARD, None, "a\u2581b", "a b"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    assert corpus_pipeline.encoding(spark, df, "")._jdf.queryExecution().executedPlan().toString().count("MapInArrow ") == 1
    got = {r.doc_id: r for r in encode_and_compare(df, c.vocabulary).collect()}
    assert all(got[i].ids == sp.encode(t or "") and got[i].exact == (sp.decode(got[i].ids) == (t or "")) for i, t in enumerate(texts)) and len(got) == len(texts)
    assert not got[len(texts) - 2].exact and got[len(texts) - 1].exact
    few = Codec(c.vocabulary, 3)
    assert FEW_SEGMENTS < MAX_SEGMENTS and all(few.encode(t or "") == c.encode(t or "") for t in texts) and len(few.kept) <= 3


def test_workers_keep_no_codec(spark, both):
    """A worker stays for later stages, so what encoding built goes when its task ends."""
    import pyarrow as pa

    from sparkfolio.llm import pieces

    c, _ = both
    docs = spark.createDataFrame([("a b",)], "text string")

    class Shown:
        columns, schema = docs.columns, docs.schema

        def mapInArrow(self, run, _):
            return run

    run = encode_and_compare(Shown(), c.vocabulary)
    out = list(run(iter([pa.RecordBatch.from_pydict({"text": ["a b", None]})])))
    assert sum(b.num_rows for b in out) == 2 and not pieces._codecs

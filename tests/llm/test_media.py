"""Media columns: exact round trips, digests by brute force, broken media."""

import hashlib
import zlib

import numpy as np
import pytest

from sparkfolio.llm import media
from sparkfolio.llm.queries import QUERIES
from tests.conftest import SF


def brute(text):
    b = (text or "").encode()
    p = b + b"\xff" * (max(576, -(-len(b) // 576) * 576) - len(b))
    return len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])


@pytest.mark.parametrize("shape", [(1, 1), (7, 5), (3, 4, 3), (9, 1, 3)])
def test_round_trips(shape):
    a = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_netpbm(a)) == a).all()
    back = media.decode(media.encode_bmp(a))
    assert (back == (a if a.ndim == 3 else np.repeat(a[..., None], 3, 2))).all()
    assert (media.from_tiles(media.npy_tiles(a, 2)) == a).all()


def test_netpbm_kinds():
    assert media.decode(b"P1 # c\n3 2\n1 0 1\n0 1 0").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P4\n3 2\n\xa0\x40").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P2\n2 1\n9\n7 8").tolist() == [[7, 8]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    for bad in (b"", b"P5", b"P5\n2 2\n255\n1", b"P9\n1 1\n1\n1", b"BM"):
        with pytest.raises((media.MediaError, IndexError, ValueError)):
            media.decode(bad)


@pytest.mark.parametrize("n,m", [(4, 2), (5, 3), (3, 7)])
def test_resize_is_the_mean_of_areas(n, m):
    a = np.random.default_rng(n).random((n, n + 1))
    fine = np.repeat(np.repeat(a, m, 0), m, 1)  # every sample cut into m * m parts
    want = fine.reshape(m, n, m, n + 1).mean((1, 3))
    assert np.allclose(media.resize_area(a, m, m), want)


def test_difference_hash():
    assert media.difference_hash(np.tile(np.arange(18), (16, 1))) == "f" * 16
    assert media.difference_hash(np.zeros((3, 3))) == "0" * 16


def test_query_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op1_media_columns"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == brute(texts[r.doc_id])
        stored = media.encode_netpbm(media.payload_image(texts[r.doc_id]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


@pytest.mark.parametrize("form", ["netpbm", "bmp"])
def test_edges(spark, form):
    rows = [(1, None, "x"), (1, None, "x"), (None, "", "y"), (2, "é" * 100_000, None), (3, "a" * 576, ""), (4, "a" * 577, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    made = media.media_from_text(df, form=form)
    got = media.payload_digests(made, keep=("doc_id",)).collect()
    assert [(r.doc_id, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got] == [(i, *brute(t)[1:]) for i, t, _ in rows]
    assert media.media_from_text(df.limit(0), form=form).count() == 0


def test_broken_media_give_reasons(spark):
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"P5\n9 9\n255\nx"), (4, media.encode_netpbm(np.ones((2, 3), np.uint8)))], "doc_id long, media binary")
    got = media.decode_media(df, keep=("doc_id",)).collect()
    assert [r.shape for r in got] == [None, None, None, [2, 3]] and [r.error is None for r in got] == [False, False, False, True]

"""Repeated strings against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from sparkfolio.llm import suffixes


def brute(texts, size):
    """(n_bytes, n_removed, n_spans, digest) of each text."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i:i + size] for b in raw for i in range(len(b) - size + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = True
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), len(b) - len(left), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return out


def test_suffix_order_and_prefixes():
    r = random.Random(3)
    for _ in range(60):
        texts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(1, 40))) for _ in range(r.randint(1, 8))]
        ends = np.cumsum([len(t) for t in texts])
        text = np.frombuffer(b"".join(texts), np.uint8)
        order, _ = suffixes.suffix_order(text, ends, 40)
        rest = [(texts[k][i:], int(ends[k]) - len(texts[k]) + i) for k in range(len(texts)) for i in range(len(texts[k]))]
        assert order.tolist() == [at for _, at in sorted(rest)]
        before, shared = suffixes.common_prefixes(text, ends, order, 12)
        of = {at: s for s, at in rest}
        for at in range(len(text)):
            if before[at] >= 0:
                a, b = of[at], of[int(before[at])]
                n = next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
                assert shared[at] == min(12, n)


def made_texts(seed, size):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage = [prose(size // 3) for _ in range(4)]
    texts = [prose(r.randint(0, 80)) for _ in range(30)]
    texts += [prose(5) + r.choice(passage) + prose(5) for _ in range(30)]
    texts += [r.choice(passage)[: size + r.randint(-3, 9)] for _ in range(10)]
    texts += ["a" * (size * 2), "ab" * size, "abc" * size, "", None, texts[3], texts[3], prose(400)]
    return texts


@pytest.mark.parametrize("hot", [3_000, 2])
def test_operator(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_CONTEXTS", hot)
    size = 40
    texts = made_texts(hot, size)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.without_repeats(df, size=size).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, size)


def test_edges(spark):
    schema = "doc_id long, text string, n_bytes string"
    assert suffixes.without_repeats(spark.createDataFrame([], schema)).count() == 0
    same = "x y " * 200
    df = spark.createDataFrame([(1, same, ""), (1, same, ""), (None, None, None), (2, "é" * 300, "")], schema)
    got = sorted(suffixes.without_repeats(df, keep=("doc_id",), kept_text="left").collect(), key=str)
    assert [(r.doc_id, r.n_bytes, r.n_removed, r.left) for r in got] == [(1, 800, 800, ""), (1, 800, 800, ""), (2, 600, 600, ""), (None, 0, 0, "")]


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(suffixes, "RUN", 3_000)
    import pyarrow as pa

    r = random.Random(5)
    text = "".join(r.choice("abcdefgh ") for _ in range(20_000))
    a = suffixes.contexts(pa.array([text]), 400)
    covered = np.zeros(20_000, int)
    for s, m in zip(a["start"], a["more"]):
        covered[s:s + m + 1] += 1
    assert (covered[:20_000 - 399] == 1).all() and not covered[20_000 - 399:].any()

"""Counts over a corpus: any fan-out gives the counts of a plain dictionary; repeated rows are dealt apart."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkfolio.llm.corpus import counted, dealt, keyed, packed, summed, unpacked
from sparkfolio.llm.textnum import U, mixed


def numbers(t):
    return [mixed(np.array([int(w) for w in x.split()], U)) for x in t["text"].to_pylist()]


def ask(t):
    return [summed(np.concatenate(numbers(t)))]


def answer(batches):
    keys, total = summed(np.concatenate([b[0][0] for b in batches]), np.concatenate([b[0][1] for b in batches]))
    return [[total[np.searchsorted(keys, b[0][0])]] for b in batches], [int(total.sum()), len(keys)]


def use(t, replies, totals):
    rows = numbers(t)
    keys = summed(np.concatenate(rows))[0]
    return pa.table({"doc_id": t["doc_id"], "sums": pa.array([int(replies[0][np.searchsorted(keys, r)].sum()) for r in rows], pa.int64()),
                     "total": pa.array([totals[0]] * len(rows), pa.int64()), "distinct": pa.array([totals[1]] * len(rows), pa.int64())})


@pytest.mark.parametrize("fan_out", [2, 3, 5, 256])
def test_counts(spark, fan_out):
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(map(str, rng.integers(0, 60, 12) ** 2))) for i in range(90)]
    docs = dealt(keyed(spark.createDataFrame(rows, "doc_id long, text string")), 11)
    got = counted(docs, 11, ask, answer, use, "doc_id bigint, sums bigint, total bigint, distinct bigint", fan_out).collect()
    all_of = Counter(w for _, t in rows for w in t.split())
    want = {i: sum(all_of[w] for w in t.split()) for i, t in rows}
    assert {r.doc_id: r.sums for r in got} == want and len(got) == 90
    assert {(r.total, r.distinct) for r in got} == {(sum(all_of.values()), len(all_of))}


def test_equal_rows_are_dealt_apart(spark):
    docs = spark.createDataFrame([(None, "same")] * 4_000, "doc_id long, text string")
    sizes = [r["count"] for r in dealt(keyed(docs), 8).groupBy("batch").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 800
    assert dealt(keyed(docs), 8).select(F.countDistinct("key")).first()[0] == 1


def test_packing():
    a = np.array([0, 1, (1 << 64) - 1, 77], U)
    assert (unpacked(packed(a)) == a).all() and len(unpacked(packed(a[:0]))) == 0

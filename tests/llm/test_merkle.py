"""Merkle manifest: brute force over odd tables, both arities, and tampered texts."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sparkfolio.llm import merkle
from sparkfolio.llm.queries import QUERIES
from tests.conftest import SF

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, arity):
    """Top, and for each leaf its list of (left, right)."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            b = a - a % arity
            paths[i].append(("".join(nodes[b:a]), "".join(nodes[a + 1:b + arity])))
        nodes = [sha(*nodes[i:i + arity]) for i in range(0, len(nodes), arity)]
        at = [a // arity for a in at]
    return nodes[0], paths


def brute(rows, arity=3):
    nulls = lambda x: (x is not None, x if x is not None else 0)
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((nulls(r[0]), leaf(*r), r))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: tree([x[1] for x in sorted(groups[s], key=lambda x: x[:2])], arity) for s in order}
    root, above = tree([tops[s][0] for s in order], arity)
    out = []
    for k, s in enumerate(order):
        for (_, own, r), path in zip(sorted(groups[s], key=lambda x: x[:2]), tops[s][1], strict=True):
            path = path + above[k]
            new = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                new = leaf(*r[:4], r[4].replace("\n", ""))
            for before, after in path:
                new = sha(before, new, after)
            out.append((r[0], own, tops[s][0], root, sha(*(a + b for a, b in path)), new, new == root))
    return out


def tampered():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0


ODD = [(None, None, None, None, None), (1, None, "en", 3, "a\nb"), (2, "a", None, None, ""), (3, "a", "en", 4, "\n\n"), (3, "a", "en", 4, "\n\n"), (3, "a", "en", 4, "x\ny"),
       (None, "a", "en", 1, "\n"), (4, "é", "fr", 5, "é\n" * 40_000), (5, "Z", "de", 1, "z")] + [(100 + i, "hot", "en", i, f"line\n{i}") for i in range(28)]


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_odd_rows(spark, arity):
    docs = spark.createDataFrame(ODD, SCHEMA).withColumns({"tree": F.lit(1), "at": F.lit("x"), "leaf": F.lit(0)}).repartition(7)
    got = merkle.document_manifest(docs, tampered(), arity).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(ODD, arity)))


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10])
def test_sizes(spark, n):
    rows = [(i, "s", "en", 1, f"{i}\n") for i in range(n)]
    got = merkle.document_manifest(spark.createDataFrame(rows, SCHEMA), tampered()).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))


def test_empty_table_and_arity(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert merkle.document_manifest(none, tampered()).collect() == []
    with pytest.raises(ValueError):
        merkle.document_manifest(none, tampered(), 1)


def test_paths_verify_only_their_leaf(spark):
    leaves = spark.range(50).select("id", (F.col("id") % 4).cast("string").alias("g"), F.sha2(F.col("id").cast("string"), 256).alias("d"))
    paths = merkle.manifest(leaves, "g", ["id"], "d", keep=("id",))
    assert paths.filter(merkle.folded(F.col("leaf"), F.col("path")) != F.col("root")).count() == 0
    assert paths.filter(merkle.folded(F.sha2(F.lit("other"), 256), F.col("path")) == F.col("root")).count() == 0


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()]
    got = QUERIES["op12_merkle_manifest"](spark, SF).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, brute(rows)))
    assert 0 < sum(not r.verified for r in got) < len(got)

"""Incremental merge of lexicons: equal to a full rebuild, touched categories only, batches that run again."""

import random
from pathlib import Path

from sparkfolio.operators import lexicon_build as lb

ROW = "category string, skill string, o long"


def test_deltas_give_the_full_merge(spark, tmp_path):
    rnd = random.Random(6)
    deltas = [[(rnd.choice(["ml", "data/é", "web", None]), rnd.choice([None, "a", "b", "c", "d", "e", "f"]), rnd.randint(0, 99)) for _ in range(n)] for n in (25, 0, 12, 18)]
    path = f"{tmp_path}/lex"
    for batch, rows in enumerate(deltas):
        frame = spark.createDataFrame(rows, ROW)
        lb.merge_delta(frame, path, batch, ["o"])
        lb.merge_delta(frame, path, batch, ["o"])  # once more, as after a crash
    got = sorted(tuple(r) for r in lb.stored_lexicon(spark, path, ["o"], "o long").collect())
    whole = lb.merge_rows([spark.createDataFrame(rows, ROW).filter("category is not null and skill is not null") for rows in deltas], ["o"])
    assert got == sorted((r.category, r.skill, r.part, r.o) for r in whole.collect()) and len(got) > 10


def test_only_touched_categories_get_files(spark, tmp_path):
    path = tmp_path / "lex"
    lb.merge_delta(spark.createDataFrame([("a", "x", 1), ("b", "y", 1)], ROW), str(path), 0, ["o"])
    before = {p: p.stat().st_mtime_ns for p in path.rglob("*.parquet")}
    added = lb.merge_delta(spark.createDataFrame([("b", "y", 2), ("b", "z", 3), ("b", "z", 2)], ROW), str(path), 1, ["o"])
    assert [(r.category, r.skill, r.o) for r in added.collect()] == [("b", "z", 2)]
    after = {p: p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}
    assert all(after[p] == m for p, m in before.items()) and all("category=b" in str(p) for p in after.keys() - before.keys())

"""Streams into tables: replayed batches add nothing, repeats are caught however late; line pairs by bands."""

import random
import shutil
from pathlib import Path

from pyspark.sql import functions as F

from sparkfolio.operators import layout as lo
from sparkfolio.operators import records as rec
from sparkfolio.sources import logs
from sparkfolio.streaming import jobs

LOG = "ts timestamp, profile_id string, sector string, extraction_method string, detection_confidence double, profile_strength_score double, word_count double, latency_ms double"


def arrive(spark, at, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{at}/{name}")


def lose_commit(checkpoint):
    """What a driver leaves that dies after the last batch was written and before it was noted."""
    last = max((Path(checkpoint) / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    crc = last.with_name(f".{last.name}.crc")
    if crc.exists():
        crc.unlink()


def test_analysis_log_stream_restarts(spark, tmp_path):
    import datetime as dt
    row = lambda i: (dt.datetime(2026, 1, 1 + i % 3), f"p{i}", "s", "ocr", 0.5, float(i), 1.0, 2.0)
    stream = lambda: jobs.file_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], LOG).schema)
    run = lambda: logs.stream_analysis_log(stream(), f"{tmp_path}/log", f"{tmp_path}/state").awaitTermination()
    count = lambda: spark.read.parquet(f"{tmp_path}/log").count()
    arrive(spark, tmp_path / "in", "a", [row(i) for i in range(7)], LOG)
    run()
    assert count() == 7
    run()
    assert count() == 7
    arrive(spark, tmp_path / "in", "b", [row(i) for i in range(10, 15)], LOG)
    run()
    assert count() == 12
    lose_commit(tmp_path / "state")
    run()  # the last batch runs again
    assert count() == 12
    held = spark.read.parquet(f"{tmp_path}/log")
    assert sorted(r.profile_id for r in held.collect()) == sorted([f"p{i}" for i in [*range(7), *range(10, 15)]])
    assert held.filter("day = '2026-01-02'").count() == held.filter("ts >= '2026-01-02' and ts < '2026-01-03'").count() > 0


def test_first_seen_has_no_state_and_no_repeats(spark, tmp_path):
    import datetime as dt
    schema = "url string, ts timestamp, n int"
    day = lambda d: dt.datetime(2026, 1, d)
    run = lambda: jobs.stored_first_seen(jobs.file_stream(spark, f"{tmp_path}/in/*", spark.createDataFrame([], schema).schema), f"{tmp_path}/out", f"{tmp_path}/state")
    urls = lambda: sorted(r.url for r in spark.read.parquet(f"{tmp_path}/out").collect())
    arrive(spark, tmp_path / "in", "a", [("u1", day(1), 1), ("u2", day(1), 2), ("u1", day(1), 3), (None, day(1), 4)], schema)
    run().awaitTermination()
    assert urls() == ["u1", "u2"]
    arrive(spark, tmp_path / "in", "b", [("u1", day(28), 5), ("u3", day(28), 6)], schema)
    run().awaitTermination()
    arrive(spark, tmp_path / "in", "c", [("u2", day(2), 7), ("u4", day(1), 8)], schema)  # four weeks late: a repeat and a first
    q = run()
    q.awaitTermination()
    assert urls() == ["u1", "u2", "u3", "u4"] and not any(p["stateOperators"] for p in q.recentProgress)
    lose_commit(tmp_path / "state")
    run().awaitTermination()
    assert urls() == ["u1", "u2", "u3", "u4"]
    shutil.rmtree(tmp_path / "in" / "a")


def test_band_pairs(spark):
    rnd = random.Random(3)
    a, b = ([(rnd.randint(1, 3), rnd.choice([None, round(rnd.uniform(-40, 90), 1)]), i) for i in range(80)] for _ in range(2))
    da, db = (spark.createDataFrame(x, "doc_id long, top double, i int") for x in (a, b))
    got = sorted((r.left.i, r.right.i) for r in lo.band_pairs(da, db, ["doc_id"], "top", 15.0).collect())
    assert got == sorted((x[2], y[2]) for x in a for y in b if x[0] == y[0] and None not in (x[1], y[1]) and abs(x[1] - y[1]) <= 15)


def test_names_as_within_one_row(spark):
    """The join over a line table finds the names that the records of packed lines have."""
    rnd = random.Random(8)
    words = ["Keo", "PEN", "Ada", "ada@mail.example.org", "06 12 34 56 78", "github.com/x", " ", "Engineer"]
    rows = [(d, i, rnd.choice(words), rnd.choice([10.0, 18.0, 20.0]), False, 0.0, float(rnd.choice([40, 50, 55, 66, 90])), rnd.choice(["left", "right", "full"]))
            for d in range(60) for i in range(rnd.randint(1, 7))]
    lines = spark.createDataFrame(rows, "doc_id long, i int, text string, size double, bold boolean, x0 double, top double, col string")
    packed = lines.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.struct("text", "size", "bold", "x0", "top", "col").alias("l")))), lambda x: x["l"]).alias("ls"))
    want = {r.doc_id: r.name for r in packed.select("doc_id", rec.header_record(F.col("ls"), F.lit(""))["name"].alias("name")).collect() if r.name is not None}
    assert {r.doc_id: r.name for r in lo.header_names(lines, F.col("i")).collect()} == want and len(want) > 40

"""Report files and log tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.streaming.jobs import StreamingQuery, each_batch_once

ANALYSIS_LOG = ("ts timestamp, profile_id string, sector string, extraction_method string, detection_confidence double, "
                "profile_strength_score double, word_count double, latency_ms double")


def write_csv_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").csv(path, header=True)


def read_csv_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def write_lexicon(rows: DataFrame, path: str) -> None:
    """Lexicon rows (category, skill) as JSON lines, one line per skill."""
    rows.select("category", "skill").write.mode("errorifexists").json(path)


def append_analysis_log(rows: DataFrame, path: str) -> None:
    """Append analysis figures, one folder per day, so readers prune by date."""
    cols = [c.split()[0] for c in ANALYSIS_LOG.split(", ")]
    rows.select(*cols, F.to_date("ts").alias("day")).write.mode("append").partitionBy("day").parquet(path)


def stream_analysis_log(stream: DataFrame, path: str, checkpoint: str, run: str = "log") -> StreamingQuery:
    """Analysis figures as they arrive, in the day folders of ``append_analysis_log``. A batch that is replayed after a crash replaces what it
    had written, so each row is there once. ``run`` names the stream; several streams may write to one path."""
    cols = [c.split()[0] for c in ANALYSIS_LOG.split(", ")]
    return each_batch_once(stream.select(*cols, F.to_date("ts").alias("day")), path, checkpoint, run, ("day",))


def benchmark_figures(rows: DataFrame) -> DataFrame:
    """(cv_count, avg_time_ms, error_count) of benchmark rows with time_ms and method."""
    return rows.agg(F.count("*").alias("cv_count"), F.round(F.avg("time_ms"), 1).alias("avg_time_ms"),
                    F.count_if(F.col("method") == "error").alias("error_count"))

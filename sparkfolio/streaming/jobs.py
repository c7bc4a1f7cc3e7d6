"""Structured Streaming jobs: first-seen listings and windowed analysis figures."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkfolio.session import scratch_dir


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 1000) -> DataFrame:
    """Parquet files arriving under a path or glob."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def _timed(stream: DataFrame, time: str) -> DataFrame:
    """Watermarks need a zoned timestamp; files may hold one without a zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp"))


def first_seen_listings(stream: DataFrame, time: str = "ts", key: str = "url", delay: str = "1 day") -> DataFrame:
    """One listing per key; state older than ``delay`` behind the newest event is dropped."""
    return _timed(stream, time).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_figures(stream: DataFrame, group: str, value: str, time: str = "ts", width: str = "1 day",
                     delay: str = "1 hour") -> DataFrame:
    """(start, group, n, avg_value) per tumbling window; rows later than ``delay`` are dropped."""
    return (_timed(stream, time).withWatermark(time, delay).groupBy(F.window(time, width).alias("w"), group)
            .agg(F.count("*").alias("n"), F.avg(value).alias("avg_value"))
            .select(F.col("w.start").alias("start"), group, "n", "avg_value"))


def each_batch_once(stream: DataFrame, path: str, checkpoint: str, run: str = "stream", partitions: Sequence[str] = (),
                    change: Callable[[DataFrame, int], DataFrame] | None = None) -> StreamingQuery:
    """Append what has arrived to Parquet under ``path``, each batch once.

    A batch has partitions of its own (``run`` and ``batch`` below ``partitions``) and replaces them, so that a batch which is replayed because its
    commit was lost adds nothing. ``change`` may rework a batch; it gets the batch number and must give the same rows when it is replayed.
    """
    def write(batch: DataFrame, number: int) -> None:
        rows = change(batch, number) if change else batch
        (rows.withColumns({"run": F.lit(run), "batch": F.lit(number).cast("long")}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*partitions, "run", "batch").parquet(path))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_first_seen(stream: DataFrame, path: str, checkpoint: str, key: str = "url", run: str = "listings") -> StreamingQuery:
    """One listing for each ``key`` ever seen, in a table that is its own memory.

    Each batch keeps one row for a key and is anti-joined with the keys of the stored table (only that column is read), its own earlier try left
    out. So nothing is held as stream state, a repeat is caught however late it comes, and a first listing is not lost for being late.
    Null keys are left out.
    """
    def unseen(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        known = spark.read.schema(f"`{key}` string, run string, batch long").parquet(path) if _has_files(spark, path) else None
        once = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        if known is None:
            return once
        before = known.filter(~((F.col("run") == run) & (F.col("batch") >= number))).select(key)
        return once.join(before, key, "left_anti")

    return each_batch_once(stream, path, checkpoint, run, (), unseen)


def _has_files(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(at) and any(s.isDirectory() for s in files.listStatus(at))


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what has arrived, write parquet under the shared folder, read it back."""
    spark = df.sparkSession
    out, state = scratch_dir(spark, name), scratch_dir(spark, name + "-state")
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", out)
         .option("checkpointLocation", state).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)

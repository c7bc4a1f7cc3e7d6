"""Session defaults, scratch folder and size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DIMENSION_ROWS = 20_000


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """Session for tests and benchmarks; on a cluster use the session you are given."""
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("sparkfolio")
               .config("spark.sql.shuffle.partitions", str(cpus))
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.driver.memory", "12g")
               .config("spark.ui.enabled", "false"))
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """New folder under ``spark.checkpoint.dir``, which all executors must share.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
        root = os.path.join(tempfile.gettempdir(), "sparkfolio")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for row-local work on an input of few files; no-op once there are enough
    input splits, so nothing is shuffled at scale."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by writing to the shared folder and reading back."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def small_or_shuffled(df: DataFrame, max_rows: int = MAX_DIMENSION_ROWS) -> DataFrame:
    """Broadcast hint only when at most ``max_rows`` rows are there; otherwise leave the join
    to the planner (sort-merge or shuffled hash)."""
    few = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if few else df


def repeated_apart(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key stands once, rows whose key repeats); null is a key too. Only keys are shuffled while few of them repeat."""
    repeated = small_or_shuffled(df.groupBy(F.col(key).alias("_key")).count().filter("count > 1").select("_key"))
    same = df[key].eqNullSafe(F.col("_key"))
    return df.join(repeated, same, "left_anti"), df.join(repeated, same, "left_semi")

"""Connected components of link tables, for any size of component."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) for the nodes of the links a - b, without the smallest ones themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    root = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        open_ = low < high
        if not open_.any():
            break
        x, y, low, high = x[open_], y[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    off = root < np.arange(len(nodes))
    return nodes[off], nodes[root[off]]


def _reduced(links: DataFrame) -> DataFrame:
    """The links of each task as stars: never more rows than nodes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in batches:
            held = forest(np.concatenate([held[0], np.asarray(b.column(0))]), np.concatenate([held[1], np.asarray(b.column(1))]))
        for i in range(0, len(held[0]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i:i + 50_000]) for x in held], ["a", "b"])

    return links.mapInArrow(run, "a long, b long")


def shared_folder(spark: SparkSession) -> None:
    """Use spark.checkpoint.dir of the session for checkpoints; only where it is unset, as in tests, a folder of our own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    at = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if not at:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        at = tempfile.mkdtemp(prefix="spark-")
    context.setCheckpointDir(at)


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of the nodes of ``links`` (columns a, b long); component is the smallest node reachable.

    Large star and small star in turn: each round hangs every node's larger neighbours on its smallest neighbour, then
    the smaller ones; rounds grow with the logarithm of a component's length. Each round is checkpointed in the shared
    folder. Nulls and self links are left out; without links the result is empty.
    """
    shared_folder(links.sparkSession)
    now = _reduced(links.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null and a <> b"))
    now = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().checkpoint()
    last = None
    for _ in range(most):
        # Large star: the larger neighbours of u go to the smallest neighbour of u, u included.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.u).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # Small star: u and its smaller neighbours go to the smallest of them.
        large = large.distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(small.select(F.col("a").alias("u"), "m"), large.a == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = hung.unionByName(small.select("a", F.col("m").alias("b"))).filter("a <> b").distinct().checkpoint()
        mark = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40))), F.lit(0))).first()
        if tuple(mark) == last:
            break
        last = tuple(mark)
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    own = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(own.select("node", F.col("node").alias("component")))

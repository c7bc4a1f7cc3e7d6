"""Labelled rows for fitting, and the joins that give them their texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 20_000  # documented bound of every fit on labelled rows


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null ids have none."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, bound: int = MAX_ROWS) -> DataFrame:
    """``docs`` (doc_id, text) that carry a label and meet ``may_learn``, with it as int ``y``.

    About ``bound`` rows: beyond it, ids are taken by a hash that is the same for every run. Null
    ids and labels are left out; an id with several labels takes the label that most rows give
    (1 on a tie). The ids are broadcast, which ``bound`` limits to some 500 kB.
    """
    known = (labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & may_learn)
             .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y")))
    n = known.count()
    if n > bound:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(n)) < bound)
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

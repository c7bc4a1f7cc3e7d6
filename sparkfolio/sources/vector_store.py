"""A table of vectors by key that fills itself: what it lacks is computed once and appended in one step."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.session import persisted

SCHEMA = "key string, vector array<float>"
_BATCH = re.compile(r"v(\d+)-from(\d+)-rows(\d+)$")


class VectorStore:
    """(key, vector) in a folder all executors reach.

    Each version is a folder of its own, written aside and moved into place when it is whole, so a lost driver or executor leaves no half
    version. Its name says how many rows it must have; a version with another count, or one that cannot be read, is passed over and its keys are
    computed again. Writers claim version numbers by creating a file. A version that was computed while another was appended may repeat keys
    of that one; readers then take the older.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs.Path
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._hadoop(self.path))

    def versions(self) -> list[tuple[int, int, int]]:
        """(version, version it was computed against, rows) of the versions in place, oldest first."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(self.path))]
        return sorted(tuple(map(int, m.groups())) for m in map(_BATCH.match, names) if m)

    def read(self) -> DataFrame:
        """All whole versions, each key once."""
        have: list[tuple[int, DataFrame]] = []
        for n, since, rows in self.versions():
            batch = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/v{n}-from{since}-rows{rows}")
            try:
                if batch.count() != rows:
                    continue
            except PySparkException:
                continue
            for m, other in have:
                if m > since:
                    batch = batch.join(other.select("key"), "key", "left_anti")
            have.append((n, batch))
        if not have:
            return self.spark.createDataFrame([], SCHEMA)
        out = have[0][1]
        for _, batch in have[1:]:
            out = out.unionByName(batch)
        return out

    def ensure(self, wanted: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> int:
        """Append the vectors of the keys that are lacking; how many those were. ``wanted`` has key and what ``compute`` needs beside it;
        ``compute`` gets the lacking rows, one for each key, and returns (key, vector). Null keys are left out. Without lacking keys nothing
        is computed or written."""
        since = max((v[0] for v in self.versions()), default=0)
        once = wanted.filter("key is not null").join(self.read().select("key"), "key", "left_anti").dropDuplicates(["key"])
        lacking = persisted(once, "lacking")
        if lacking.isEmpty():
            return 0
        aside = f"{self.path}/.{uuid.uuid4().hex}"
        compute(lacking).select("key", F.col("vector").cast("array<float>").alias("vector")).write.parquet(aside)
        rows, n = self.spark.read.parquet(aside).count(), since + 1
        while not self._fs.createNewFile(self._hadoop(f"{self.path}/claim-{n}")):
            n += 1
        if not self._fs.rename(self._hadoop(aside), self._hadoop(f"{self.path}/v{n}-from{since}-rows{rows}")):
            raise OSError(f"version {n} of {self.path} could not be moved into place")
        return rows

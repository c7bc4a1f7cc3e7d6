"""Profile catalogues: caller data read from JSON or parquet.

One row per profile: profile_id, sector_key, sector, job_title, aliases, keywords.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.operators.profiles import Profile

SCHEMA = "profile_id string, sector_key string, sector string, job_title string, aliases array<string>, keywords array<string>"


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(SCHEMA)
    return reader.parquet(path) if path.endswith(".parquet") else reader.json(path, multiLine=True)


def profile_list(profiles: DataFrame, most: int = 2_000) -> list[Profile]:
    """Catalogue rows as a list, for ``forced`` and other expressions over few profiles; more than ``most`` are an error. ``detect`` takes the
    table itself, of any size."""
    rows = profiles.orderBy("profile_id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} profiles")
    return [Profile(r.profile_id, r.sector, r.job_title, list(r.aliases or []), list(r.keywords or []), r.sector_key) for r in rows]


def profiles_by_sector(profiles: DataFrame) -> DataFrame:
    """(sector, profile_ids): sorted ids per sector, repeats removed before collecting."""
    return profiles.select("sector", "profile_id").distinct().groupBy("sector").agg(
        F.sort_array(F.collect_list("profile_id")).alias("profile_ids"))

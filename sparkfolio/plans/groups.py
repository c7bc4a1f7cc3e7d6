"""Before/after reports per group of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def group_report(rows: DataFrame) -> DataFrame:
    """(grp, n, avg_before, avg_after, avg_delta, detected) per group and for all (TOTAL).

    ``rows`` has grp, before, after, detected; one aggregate with grouping sets.
    """
    agg = rows.rollup("grp").agg(
        F.grouping("grp").alias("g"), F.count("*").alias("n"), F.round(F.avg("before"), 1).alias("avg_before"),
        F.round(F.avg("after"), 1).alias("avg_after"), F.round(F.avg(F.col("after") - F.col("before")), 1).alias("avg_delta"),
        F.count_if("detected").alias("detected"))
    return agg.withColumn("grp", F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("grp"))).drop("g")


def detection_checks(rows: DataFrame) -> DataFrame:
    """Share detected, non-tech average with its target, tech regressions below -10."""
    non_tech = F.avg(F.when(F.col("grp") == "non-tech", F.col("after")))
    return rows.agg(
        F.round(F.count_if("detected") * 100.0 / F.count("*"), 0).alias("detected_pct"), F.round(non_tech, 1).alias("non_tech_avg"),
        (non_tech >= 50).alias("non_tech_ok"),
        F.count_if((F.col("grp") == "tech") & (F.col("after") - F.col("before") < -10)).alias("tech_regressions"))

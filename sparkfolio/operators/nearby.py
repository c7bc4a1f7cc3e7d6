"""Spatial range join: points within a distance of each other, by grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance by the haversine formula, degrees in, kilometres out."""
    a, b = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def within(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """(left_id, right_id, km) of the points of ``left`` and ``right`` (id, lat, lon) at most ``km`` apart, a point itself included.

    The earth is cut into bands as high as the distance and cells along them. A point of ``right`` is in one cell; a point of ``left`` goes to the
    cells that its circle can touch (few, more near the poles), and only points of one cell are measured. Points without coordinates are near nothing.
    """
    r = km / EARTH_KM
    height = math.degrees(r)
    cells = max(1, int(180 / height))
    width = 360 / cells
    band = F.floor((F.col("lat") + 90) / height)
    lon = F.pmod(F.col("lon") + 180, F.lit(360.0))
    left, right = (p.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon")).filter("lat is not null and lon is not null")
                   for p in (left, right))
    reach = F.when(F.abs("lat") + height >= 90, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), math.sin(min(r, math.pi / 2)) / F.cos(F.radians("lat"))))))
    low = F.floor((lon - reach) / width)
    high = F.least(F.floor((lon + reach) / width), low + cells - 1)
    asks = (left.select(F.col("id").alias("left_id"), F.col("lat").alias("a"), F.col("lon").alias("o"), F.explode(F.sequence(band - 1, band + 1)).alias("band"), low.alias("low"), high.alias("high"))
            .select("left_id", "a", "o", "band", F.explode(F.sequence("low", "high")).alias("c")).withColumn("cell", F.pmod("c", F.lit(cells))).drop("c"))
    stands = right.select(F.col("id").alias("right_id"), F.col("lat").alias("b"), F.col("lon").alias("p"), band.alias("band"), F.pmod(F.floor(lon / width), F.lit(cells)).alias("cell"))
    met = asks.join(stands, ["band", "cell"]).select("left_id", "right_id", distance_km(F.col("a"), F.col("o"), F.col("b"), F.col("p")).alias("km"))
    return met.filter(F.col("km") <= km)

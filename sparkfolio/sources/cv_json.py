"""Structured records from JSON answers of an extraction model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio import schemas as sc
from sparkfolio.functions import text as tx
from sparkfolio.functions.arrays import sealed
from sparkfolio.operators.records import rebuilt_text

_SHAPE = (f"header {sc.HEADER}, summary string, skills {sc.SKILLS}, experience {sc.EXPERIENCE}, education {sc.EDUCATION}, "
          f"projects {sc.PROJECTS}, languages array<string>, _bad string")


def json_body(c: Column) -> Column:
    """Text from the first { to the last }, markdown fences removed; null when there is none."""
    plain = F.regexp_replace(c, r"```(?:json)?\s*", "")
    body = F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    return F.nullif(body, F.lit(""))


def text_items(items: Column) -> Column:
    """Items as texts; an object gives its first non-blank text value."""
    def one(x):
        values = F.map_values(F.from_json(x, "map<string,string>"))
        return F.when(x.startswith("{"), F.get(F.filter(values, lambda v: tx.strip(v) != ""), F.lit(0))).otherwise(x)

    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), one), lambda x: x.isNotNull())


def read_cv_json(raw: DataFrame, column: str, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(records, quarantine): parsed rows and rows without readable JSON."""
    body = json_body(F.col(column))
    parsed = F.from_json(body, _SHAPE, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    df = sealed(raw.select(key, F.col(column).alias("_raw"), parsed.alias("r")))
    ok = F.col("r").isNotNull() & F.col("r._bad").isNull()
    empty = {"experience": sc.EXPERIENCE, "education": sc.EDUCATION, "projects": sc.PROJECTS}
    rec = df.filter(ok).select(
        key, "r.header", "r.summary", F.coalesce("r.skills", F.create_map().cast(sc.SKILLS)).alias("skills"),
        *[F.coalesce(f"r.{c}", F.array().cast(t)).alias(c) for c, t in empty.items()], text_items(F.col("r.languages")).alias("languages"))
    text = rebuilt_text(F.col("header"), F.col("summary"), F.col("skills"), F.col("experience"), F.col("education"), F.col("projects"))
    rec = (rec.withColumn("raw_text", text).withColumn("word_count", tx.word_count(F.col("raw_text")))
           .withColumn("layout_detected", F.lit("single_column")).withColumn("extraction_method", F.lit("vision_llm"))
           .withColumn("extraction_confidence", F.lit(0.95)))
    return rec, df.filter(~ok).select(key, F.col("_raw").alias(column))

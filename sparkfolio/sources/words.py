"""Positioned words as a source of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions.arrays import sealed
from sparkfolio.operators import records as rec
from sparkfolio.operators.layout import document_lines
from sparkfolio.schemas import WORD


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Word table from parquet: doc_id, page, text, x0, x1, top, bottom, size, fontname."""
    return spark.read.schema(WORD).parquet(path)


def parse_words(words: DataFrame, as_of: tuple[int, int] = (2026, 1), lexicon: dict[str, list[str]] = lx.SKILLS,
                fields=rec.RECORD_FIELDS) -> DataFrame:
    """Word tables to records, with column layout, line assembly and typography."""
    docs = document_lines(words)
    chunks = rec.section_chunks(F.col("lines"), F.col("body_size"))
    own = rec.section_lines(chunks, "header")
    both = F.when(F.col("layout") == "two_columns", F.transform(F.sort_array(F.transform(
        F.array_distinct(F.concat(own, "top_lines")), lambda x, i: F.struct(x["top"].alias("t"), i.alias("i"), x.alias("x")))),
        lambda k: k["x"])).otherwise(own)
    df = rec.parse_lines(docs.withColumn("_head", both), "lines", F.col("body_size"), as_of, positioned=True,
                         lexicon=lexicon, header_lines="_head", fields=fields)
    df = df.drop("lines", "top_lines", "body_size", "_head").withColumnRenamed("layout", "layout_detected") \
        .withColumn("extraction_method", F.lit("pdfplumber"))
    return sealed(df)

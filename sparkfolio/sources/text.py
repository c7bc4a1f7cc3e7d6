"""Plain-text documents as a source of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.operators.records import text_lines


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row per text file, whole file in the row."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def line_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, text, max_size, is_bold, x0, top, column) of plain texts."""
    return (docs.select(key, F.posexplode(text_lines(F.col(text))).alias("line_no", "l"))
            .select(key, "line_no", F.col("l.text").alias("text"), F.col("l.size").alias("max_size"),
                    F.col("l.bold").alias("is_bold"), F.col("l.x0").alias("x0"), F.col("l.top").alias("top"),
                    F.col("l.col").alias("column")))

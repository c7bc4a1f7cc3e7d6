"""Corpus pipeline: documents in, documents encoded out. Each stage applies one operator to all that the stage before it kept.

Columns of documents: doc_id, text, lang, source, n_chars. Every stage but the last returns these; extra columns of an input are
dropped. Null and empty texts pass the quality stage by their score and are otherwise kept as empty texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import pieces, queries, rules, setjoin, suffixes
from sparkfolio.llm.training import labelled_sample
from sparkfolio.session import persisted

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
QUALITY = 0.3
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.3 or more. It learns from all labelled rows of the input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = rules.fit_quality(labelled_sample(docs, labels, "quality", F.lit(True)))
    return rules.with_stats(docs.select(*COLUMNS)).filter(model.score_column() >= QUALITY).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked ones: the one with the smallest id (rows without an id last, then the first in the table).
    Rows that repeat another, with or without an id, are of its group. Rows without words link with nothing and all stay."""
    rows = docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id())  # docs is a table, so a row keeps its number
    found = persisted(setjoin.jaccard_components(rows, keep=("_row",), group="_group").filter("_group is not null").select("doc_id", "_row", "_group"), "groups")
    stays = found.groupBy("_group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_stays"))
    goes = found.join(persisted(stays, "stays"), "_group").filter("_row <> _stays").select("_row")
    return rows.join(goes, "_row", "left_anti").select(*COLUMNS)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 400 bytes that stand in several places; n_chars counts what is left."""
    cut = suffixes.without_repeats(docs, keep=("doc_id", "lang", "source"), kept_text="text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the probabilities that bring sources, languages and topics to their target shares."""
    return queries.mixed(docs.select(*COLUMNS)).filter("mix_kept").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of the text, their number, and whether decoding gives the text back."""
    vocabulary = pieces.Vocabulary.from_model(queries.piece_model())
    back = pieces.encode_and_compare(docs.select("doc_id", "lang", "source", "text"), vocabulary)
    return back.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "exact")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixing", mixing), ("encoding", encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of ``sf_dir``, each but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = persisted(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

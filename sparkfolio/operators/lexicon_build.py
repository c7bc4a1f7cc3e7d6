"""Building and merging skill lexicons from datasets and occupation records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions.skills import categorise_skill, normalise_skill
from sparkfolio.functions.text import lit_array
from sparkfolio.session import persisted

LEXICON = ("skill_categories map<string,array<string>>, job_titles array<string>, action_verbs_en array<string>, "
           "action_verbs_fr array<string>, embedded_skills array<string>, sources array<string>")
OCCUPATION = "uri string, title string, _links struct<hasEssentialSkill:array<struct<title:string>>>"


def lexicon_rows(lexicons: DataFrame, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """(category, skill, pos) rows of lexicon JSON texts."""
    parsed = F.from_json(F.col(json), LEXICON)["skill_categories"]
    return lexicons.select(*keep, F.explode(parsed).alias("category", "_s")).select(
        *keep, "category", F.posexplode("_s").alias("pos", "skill"))


def merge_rows(parts: Sequence[DataFrame], order: Sequence[str], ignore_case: bool = False, per_category: bool = True) -> DataFrame:
    """Union of (category, skill, <order>) frames, the earlier frame and earlier row kept.

    One aggregate with partial combine; repeats of a skill shrink in every task before the shuffle.
    """
    both = None
    for i, p in enumerate(parts):
        p = p.select("category", "skill", *order).withColumn("_part", F.lit(i))
        both = p if both is None else both.unionByName(p)
    key = F.lower("skill") if ignore_case else F.col("skill")
    keys = [key.alias("_k")] + ([F.col("category").alias("_c")] if per_category else [])
    first = F.min_by(F.struct("category", "skill", "_part", *order), F.struct("_part", *order)).alias("r")
    return both.groupBy(*keys).agg(first).select("r.category", "r.skill", F.col("r._part").alias("part"), *[f"r.{o}" for o in order])


STORED = "category string, batch long"


def stored_lexicon(spark: SparkSession, path: str, order: Sequence[str], kinds: str) -> DataFrame:
    """(category, skill, batch, <order>) of a lexicon that ``merge_delta`` keeps; ``kinds`` is the schema of ``order``."""
    return spark.read.schema(f"skill string, {kinds}, {STORED}").parquet(path).select("category", "skill", "batch", *order)


def merge_delta(delta: DataFrame, path: str, batch: int, order: Sequence[str]) -> DataFrame:
    """Merge (category, skill, <order>) rows into the stored lexicon and return what is new.

    The first sight of a skill in a category stays: of a smaller batch, and within a batch of the smallest ``order``. Only categories of the delta
    are read, and only files for what is new in them are added, so the cost follows the delta and its categories. A batch that runs again
    replaces what it had written; batches must come in ascending order. Null categories and skills are left out.
    """
    spark = delta.sparkSession
    once = merge_rows([delta.filter("category is not null and skill is not null")], order).select("category", "skill", *order)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at) and any(s.isDirectory() for s in files.listStatus(at)):
        known = spark.read.schema(f"skill string, {STORED}").parquet(path).filter(F.col("batch") < batch)
        once = once.join(known.join(once.select("category").distinct(), "category", "left_semi").select("category", "skill"), ["category", "skill"], "left_anti")
    new = persisted(once.withColumn("batch", F.lit(batch).cast("long")), "delta")
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("category", "batch").parquet(path)
    return new


def new_words(words: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Rows whose word is not in ``known`` (anti join, planner chooses the strategy)."""
    return words.join(known, column, "left_anti")


def skill_column(columns: Sequence[str]) -> str | None:
    """First column that looks like skills."""
    return next((c for c in ("skill", "skills", "name", "label", "text", "title") if c in columns), None)


def dataset_skills(dataset: DataFrame) -> DataFrame:
    """(category, skill): distinct lower-cased skills of at most four words."""
    column = skill_column(dataset.columns)
    if column is None:
        raise ValueError(f"no skill column among {dataset.columns}")
    s = F.lower(F.trim(F.col(column)))
    words = F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    return (dataset.select(s.alias("skill"), words.alias("_n")).filter("skill <> '' and _n <= 4").select("skill").distinct()
            .select(categorise_skill(F.col("skill")).alias("category"), "skill"))


def occupation_skills(occupations: DataFrame, json: str, keep: Sequence[str] = ()) -> DataFrame:
    """(title, category, skill, pos): normalised essential skills of occupation JSON records."""
    o = occupations.select(*keep, F.from_json(F.col(json), OCCUPATION).alias("o"))
    rows = o.select(*keep, F.lower("o.title").alias("title"), F.posexplode("o._links.hasEssentialSkill").alias("pos", "s"))
    return (rows.withColumn("skill", normalise_skill(F.col("s.title"))).filter("skill is not null")
            .select(*keep, "title", categorise_skill(F.col("skill")).alias("category"), "skill", "pos"))


def best_occupation(results: DataFrame, query_key: str = "query_id") -> DataFrame:
    """First search result that shares a telling word with its query; (query_key, rank, title).

    ``results`` has query_key, query, rank, title.  A query of only common words takes the first.
    """
    def telling(c: Column) -> Column:
        return F.array_except(F.split(F.lower(F.trim(c)), r"\s+"), lit_array(lx.TRIVIAL_OCCUPATION_WORDS))

    q = telling(F.col("query"))
    ok = (F.size(q) == 0) | F.arrays_overlap(q, telling(F.col("title")))
    return results.filter(ok).groupBy(query_key).agg(F.min_by(F.struct("rank", F.lower("title").alias("title")), "rank").alias("r")) \
        .select(query_key, "r.rank", "r.title")


def phrases(skills: DataFrame, blocked: Sequence[str] = ()) -> DataFrame:
    """Distinct skills of two words or more, not blocked."""
    many = F.size(F.filter(F.split("skill", r"\s+"), lambda w: w != "")) >= 2
    out = skills.filter(many).select("skill").distinct()
    return out.filter(~F.col("skill").isin(*blocked)) if blocked else out


def lexicon_stats(rows: DataFrame) -> DataFrame:
    """(category, skills) per category and for all (TOTAL)."""
    return rows.rollup("category").agg(F.grouping("category").alias("g"), F.count("*").alias("skills")).select(
        F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("category")).alias("category"), "skills")


def build_lexicon(sources: Sequence[DataFrame]) -> DataFrame:
    """(category, skill, part): sources merged in order, per category, first occurrence kept."""
    return merge_rows([s.withColumn("o", F.col("skill")) for s in sources], ["o"])


def sector_keywords(sectors: DataFrame, results: DataFrame, occupations: DataFrame) -> DataFrame:
    """(sector, skill): distinct skills of the occupations found for the queries of a sector.

    ``sectors`` is (sector, query_id), ``results`` as in ``best_occupation``, ``occupations`` as
    from ``occupation_skills``.
    """
    found = best_occupation(results).join(sectors, "query_id")
    return found.join(occupations, "title").select("sector", "skill").distinct()

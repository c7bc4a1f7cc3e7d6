"""Quality report of many records as one projection (no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import dates
from sparkfolio.functions.skills import all_skills, with_grams
from sparkfolio.operators import report as rp
from sparkfolio.operators import timeline as tl


def quality_report(cv: DataFrame, as_of: tuple[int, int], lexicon: dict[str, list[str]] = lx.SKILLS) -> DataFrame:
    """Readability, strength, recommendations, career figures and gaps, one row per record."""
    df = with_grams(rp.with_signals(cv), F.col("raw_text"), "_hits", all_skills(lexicon))
    density = F.when(F.col("word_count") > 0, F.size("_hits") / F.col("word_count")).otherwise(0.0)
    starts = F.array_min(F.filter(F.transform("experience", lambda e: dates.year_month(e["date_start"])["y"]), lambda y: y.isNotNull()))
    edu = F.aggregate("education", F.lit(0), lambda a, e: a + F.coalesce(e["duration_months"], F.lit(0)))
    score = rp.strength_score()
    return df.select(
        "doc_id", F.col("layout_detected").alias("layout"), rp.readability_label(F.col("layout_detected")).alias("layout_label"),
        rp.detected_sections().alias("sections_found"), rp.missing_sections().alias("sections_missing"),
        "extraction_method", "extraction_confidence", (F.col("word_count") >= 150).alias("is_machine_readable"),
        score.alias("strength"), rp.level(score).alias("level"), rp.strengths().alias("strengths"),
        rp.improvements().alias("improvements"), rp.recommendations(density).alias("recommendations"),
        rp.total_experience_years().alias("total_experience_years"), starts.alias("career_start_year"),
        rp.most_recent_role().alias("most_recent_role"), F.bround(edu / 12, 0).cast("int").alias("education_years"),
        tl.career_gaps(F.col("experience"), F.col("education"), as_of).alias("career_gaps"))

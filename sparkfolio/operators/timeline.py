"""Career timelines: gaps, totals, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions import dates
from sparkfolio.functions.arrays import int_range, let


def _intervals(entries: Column, as_of: tuple[int, int]) -> Column:
    now = as_of[0] * 12 + as_of[1]

    def one(e):
        end = F.coalesce(e["date_end"], F.lit(""))
        last = F.when(e["is_current"] | (end == "") | (end == "present"), F.lit(now)).otherwise(
            dates.month_index(dates.year_month(end)))
        return F.struct(dates.month_index(dates.year_month(e["date_start"])).alias("s"), last.alias("e"))

    return F.filter(F.transform(entries, one), lambda x: x["s"].isNotNull() & x["e"].isNotNull())


def gap_text(start: Column, end: Column) -> Column:
    years = F.bround(F.round((end - start) / 12, 1), 0).cast("int").cast("string")
    return F.concat(F.floor(start / 12).cast("string"), F.lit("–"), F.floor(end / 12).cast("string"), F.lit(" : "),
                    years, F.lit(" an(s) sans activité détectée"))


def career_gaps(experience: Column, education: Column, as_of: tuple[int, int], months: int = 12,
                merged: bool = False) -> Column:
    """Gap texts of one record's timeline (array<string>).

    Neighbours in start order are compared; with ``merged`` a gap also has to lie after every
    earlier end.
    """
    def ordered(iv):
        keyed = F.transform(iv, lambda x, i: F.struct(x["s"].alias("s"), i.alias("i"), x["e"].alias("e")))
        return let(F.sort_array(keyed), gaps)

    def gaps(iv):
        idx = int_range(F.lit(1), F.size(iv) - 1)
        reach = (lambda i: F.array_max(F.transform(F.slice(iv, F.lit(1), i), lambda x: x["e"]))) if merged else (
            lambda i: F.get(iv, i - 1)["e"])
        pairs = F.transform(idx, lambda i: F.struct(reach(i).alias("a"), F.get(iv, i)["s"].alias("b")))
        return F.transform(F.filter(pairs, lambda p: p["b"] - p["a"] > months), lambda p: gap_text(p["a"], p["b"]))

    return let(F.concat(_intervals(experience, as_of), _intervals(education, as_of)), ordered)


def gaps_by_key(df: DataFrame, key: str, start: str, end: str, order: str, months: int) -> DataFrame:
    """(key, gap_start, gap_end) over an interval table of any group size.

    Months are few, so rows are first reduced to one per key and start month, partly before the
    shuffle; only those reduced rows are ordered per key.  A key holding a third of all rows
    leaves at most one row per calendar month.  Rows that start in the same month can only leave
    a gap between themselves where an end lies before its start; those are found row by row.
    """
    ranked = df.select(key, F.col(start).alias("s"), F.col(end).alias("e"), F.col(order).alias("o"))
    per_month = ranked.groupBy(key, "s").agg(F.max_by("e", "o").alias("e"), F.max("o").alias("o"))
    w = Window.partitionBy(key).orderBy("s")
    between = per_month.withColumn("n", F.lead("s").over(w)).filter(F.col("n") - F.col("e") > months) \
        .select(key, F.col("e").alias("gap_start"), F.col("n").alias("gap_end"))
    odd = ranked.filter(F.col("s") - F.col("e") > months)
    inside = odd.join(per_month.select(key, "s", F.col("o").alias("last")), [key, "s"]).filter(F.col("o") < F.col("last")) \
        .select(key, F.col("e").alias("gap_start"), F.col("s").alias("gap_end"))
    return between.unionByName(inside)


def career_stats(cv: DataFrame) -> DataFrame:
    """(doc_id, total_experience_years, career_start_year, most_recent_role, education_years)."""
    from sparkfolio.operators.report import most_recent_role, total_experience_years

    starts = F.array_min(F.filter(F.transform("experience", lambda e: dates.year_month(e["date_start"])["y"]),
                                  lambda y: y.isNotNull()))
    edu = F.aggregate("education", F.lit(0), lambda a, e: a + F.coalesce(e["duration_months"], F.lit(0)))
    return cv.select("doc_id", total_experience_years().alias("total_experience_years"),
                     starts.alias("career_start_year"), most_recent_role().alias("most_recent_role"),
                     F.bround(edu / 12, 0).cast("int").alias("education_years"))


def timeline(experience: Column, education: Column) -> Column:
    """array<struct<kind,label,y,m>> of both lists, latest start first, stable."""
    def start(e):
        p = F.split(e["date_start"], "-")
        return F.coalesce(F.get(p, F.lit(0)).cast("int"), F.lit(0)), F.coalesce(
            F.get(p, F.lit(1)).cast("int"), F.lit(1))

    def job(e):
        y, m = start(e)
        label = F.coalesce(F.nullif(F.concat_ws(" @ ", F.nullif(e["title"], F.lit("")), F.nullif(e["company"], F.lit(""))),
                                    F.lit("")), F.lit("Poste non détecté"))
        return F.struct(F.lit("experience").alias("kind"), label.alias("label"), y.alias("y"), m.alias("m"))

    def school(e):
        y, m = start(e)
        label = F.coalesce(F.nullif(F.concat_ws(" — ", F.nullif(e["degree"], F.lit("")), F.nullif(e["school"], F.lit(""))),
                                    F.lit("")), F.lit("Formation non détectée"))
        return F.struct(F.lit("education").alias("kind"), label.alias("label"), y.alias("y"), m.alias("m"))

    both = F.concat(F.transform(experience, job), F.transform(education, school))
    keyed = F.transform(both, lambda x, i: F.struct((-x["y"]).alias("y"), (-x["m"]).alias("m"), i.alias("i"), x.alias("x")))
    return F.transform(F.sort_array(keyed), lambda k: k["x"])

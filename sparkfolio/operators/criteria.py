"""Weighted criteria: rule registry, templates, evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import text as tx
from sparkfolio.functions.arrays import let
from sparkfolio.operators import report as rp
from sparkfolio.session import small_or_shuffled

# --- fixed values: evidence texts, (met, not met) or one text ---------------------------------
EVIDENCE = {
    "experience": ("%d expérience(s) détectée(s)", "Aucune expérience détectée"),
    "education": ("%d formation(s) / diplôme(s) détecté(s)", "Aucune formation détectée"),
    "summary": ("Accroche/profil présent", "Accroche/profil absente"),
    "dates": ("%d/%d expériences datées (%d%%)", "Aucune expérience — dates non vérifiables"),
    "words": "%d mots détectés (seuil : 300)",
    "email": "Email détecté",
    "phone": "Téléphone détecté",
    "no_contact": "Ni email ni téléphone détectés",
    "tech_skills": "%d compétences techniques détectées",
    "sector_count": "%d compétences sectorielles",
    "sector": ("Mots-clés trouvés : %s", "Aucun mot-clé sectoriel détecté"),
    "metrics": ("Métriques chiffrées présentes", "Aucune métrique chiffrée détectée"),
    "projects": ("%d projet(s) documenté(s)", "Aucun projet documenté"),
    "profile": ("%d/%d mots-clés métier (%d%%)", "Aucun mot-clé métier configuré"),
    "qualification": ("Habilitations trouvées : %s", "Aucune habilitation détectée"),
    "languages": ("%d langue(s) détectée(s)", "Aucune langue étrangère détectée"),
    "own": ("Mots-clés trouvés : %s", "Aucun mot-clé détecté dans le CV"),
    "own_empty": "Aucun mot-clé configuré",
    "unknown": "Fonction '%s' non implémentée",
}

# rule name -> builder(keywords column) -> (met, evidence), both Columns over a record
Rule = Callable[[Column], tuple[Column, Column]]
RULES: dict[str, Rule] = {}


def rule(name: str):
    """Register a rule; users add their own the same way."""

    def add(fn: Rule) -> Rule:
        RULES[name] = fn
        return fn

    return add


def _say(met: Column, key: str, *values: Column) -> Column:
    yes, no = EVIDENCE[key]
    return F.when(met, F.format_string(yes, *values) if values else F.lit(yes)).otherwise(no)


def _at_least_one(rule_name: str, column: str, key: str) -> None:
    """Rules that only ask whether a list of the record has an entry."""

    @rule(rule_name)
    def _(_keywords):
        n = F.size(column)
        return n >= 1, _say(n >= 1, key, n)


for _rule, _column, _key in (("has_experience", "experience", "experience"), ("has_education", "education", "education"),
                             ("has_projects", "projects", "projects"), ("has_languages", "languages", "languages")):
    _at_least_one(_rule, _column, _key)


def _percent(part: Column, whole: Column) -> Column:
    return F.bround(part / F.greatest(whole, F.lit(1)) * 100, 0).cast("int")


def _check_text() -> Column:
    return F.lower(F.concat(F.col("raw_text"), F.lit(" "), F.array_join("skills_flat", " ")))


def _found(keywords: Column, text_lower: Column) -> Column:
    """Keywords that stand in the text, which is made once and not again for each keyword."""
    return let(text_lower, lambda t: F.filter(keywords, lambda k: F.contains(t, F.lower(k))))


@rule("has_summary")
def _(_keywords):
    met = F.coalesce("summary", F.lit("")) != ""
    return met, _say(met, "summary")


@rule("has_dates")
def _(_keywords):
    n = F.size("experience")
    dated = F.size(F.filter("experience", lambda e: F.coalesce(e["date_start"], F.lit("")) != ""))
    return rp.has_dates(), _say(n > 0, "dates", dated, n, _percent(dated, n))


@rule("has_sufficient_words")
def _(_keywords):
    return F.col("word_count") >= 300, F.format_string(EVIDENCE["words"], F.col("word_count"))


@rule("has_contact")
def _(_keywords):
    mail, tel = (F.coalesce(F.col("header")[f], F.lit("")) != "" for f in ("email", "phone"))
    names = F.concat_ws(" | ", F.when(mail, EVIDENCE["email"]), F.when(tel, EVIDENCE["phone"]))
    return mail | tel, F.coalesce(F.nullif(names, F.lit("")), F.lit(EVIDENCE["no_contact"]))


@rule("has_tech_skills")
def _(_keywords):
    n = F.size("skills_flat")
    return n >= 5, F.format_string(EVIDENCE["tech_skills"], n)


@rule("has_sector_skills")
def _(keywords):
    hits, n = _found(keywords, _check_text()), F.size("skills_flat")
    free = F.size(keywords) == 0
    some = F.size(hits) > 0
    return (F.when(free, n >= 3).otherwise(some),
            F.when(free, F.format_string(EVIDENCE["sector_count"], n)).otherwise(_say(some, "sector", F.array_join(hits, ", "))))


@rule("has_metrics")
def _(_keywords):
    return rp.has_metrics(), _say(rp.has_metrics(), "metrics")


@rule("has_profile_keywords")
def _(keywords):
    hits, n = F.size(_found(keywords, _check_text())), F.size(keywords)
    return (n > 0) & (hits / F.greatest(n, F.lit(1)) >= 0.3), _say(n > 0, "profile", hits, n, _percent(hits, n))


@rule("has_habilitations")
def _(_keywords):
    hits = _found(tx.lit_array(lx.QUALIFICATION_WORDS), F.lower("raw_text"))
    return F.size(hits) > 0, _say(F.size(hits) > 0, "qualification", F.array_join(F.slice(hits, 1, 5), ", "))


@rule("has_ai_criterion")
def _(keywords):
    hits = _found(keywords, F.lower("raw_text"))
    text = F.when(F.size(keywords) == 0, EVIDENCE["own_empty"]).otherwise(_say(F.size(hits) > 0, "own", F.array_join(hits, ", ")))
    return F.size(hits) > 0, text


def rule_result(name: str, keywords: Column) -> Column:
    """struct(score, evidence) of one rule on the record columns."""
    met, evidence = RULES[name](keywords)
    return F.struct(F.when(F.coalesce(met, F.lit(False)), 100).otherwise(0).alias("score"), evidence.alias("evidence"))


# --- templates --------------------------------------------------------------------------------
CRITERION = "profile_id string, ord int, criterion_id string, label string, rule string, weight int, required boolean, keywords array<string>"


def templates_frame(spark, templates=None, overrides=None) -> tuple[DataFrame, DataFrame]:
    """(sector_key, ord, criterion_id, weight, required) and the same per profile override."""
    templates = lx.SECTOR_TEMPLATES if templates is None else templates
    overrides = lx.PROFILE_OVERRIDES if overrides is None else overrides
    rows = lambda d: [(k, i, c, w, r) for k, spec in d.items() for i, (c, w, r) in enumerate(spec)]
    ddl = "{0} string, ord int, criterion_id string, weight int, required boolean"
    return (spark.createDataFrame(rows(templates), ddl.format("sector_key")),
            spark.createDataFrame(rows(overrides), ddl.format("profile_id")))


def definitions_frame(spark) -> DataFrame:
    rows = [(c, label, fn, kws) for c, (label, fn, kws) in lx.CRITERION_DEFS.items()]
    return spark.createDataFrame(rows, "criterion_id string, label string, rule string, default_keywords array<string>")


def build_criteria(profiles: DataFrame, templates: DataFrame, overrides: DataFrame, definitions: DataFrame) -> DataFrame:
    """Criteria per profile: override first, else the sector template.

    ``profiles`` has profile_id, sector_key, keywords; the profile's own keywords replace the
    defaults in ``eval_profile_keywords``.  A profile without template or with an unknown
    criterion fails the job when its row is read.
    """
    own = profiles.join(overrides.select("profile_id").distinct().withColumn("has_own", F.lit(True)), "profile_id", "left")
    a = own.filter("has_own").join(overrides, "profile_id")
    b = own.filter("has_own is null").join(templates, "sector_key", "left")
    spec = a.select("profile_id", "sector_key", "keywords", "ord", "criterion_id", "weight", "required").unionByName(
        b.select("profile_id", "sector_key", "keywords", "ord", "criterion_id", "weight", "required"))
    spec = spec.withColumn("criterion_id", F.coalesce("criterion_id", F.raise_error(
        F.concat(F.lit("no criteria template for sector "), "sector_key"))))
    out = spec.join(definitions, "criterion_id", "left")
    return out.select(
        "profile_id", "ord", "criterion_id",
        F.coalesce("label", F.raise_error(F.concat(F.lit("unknown criterion "), "criterion_id"))).alias("label"),
        "rule", "weight", "required",
        F.when(F.col("criterion_id") == "eval_profile_keywords", F.col("keywords")).otherwise(F.col("default_keywords")).alias("keywords"))


def generic_criteria(spark) -> DataFrame:
    rows = [(lx.GENERIC_PROFILE_ID, i, cid, label, fn, w, req, kws)
            for i, (cid, label, w, req, fn, kws) in enumerate(lx.GENERIC_CRITERIA)]
    return spark.createDataFrame(rows, CRITERION)


def weight_errors(criteria: DataFrame) -> DataFrame:
    """Profiles whose weights do not sum to 100."""
    return criteria.groupBy("profile_id").agg(F.sum("weight").alias("total")).filter("total <> 100")


# --- evaluation -------------------------------------------------------------------------------
def evaluate(cv: DataFrame, criteria: DataFrame, profile: str = "profile_id") -> DataFrame:
    """One row per record and criterion: score, evidence, weighted_score.

    Unknown profiles are evaluated with the generic criteria.  Criteria are packed per profile,
    so a record meets one row and its text is not repeated per criterion.
    """
    spark = cv.sparkSession
    both = criteria.select(*[c.split()[0] for c in CRITERION.split(", ")]).unionByName(generic_criteria(spark))
    packed = both.groupBy("profile_id").agg(F.sort_array(F.collect_list(F.struct(
        "ord", "criterion_id", "label", "rule", "weight", "required", "keywords"))).alias("criteria"))
    dims = small_or_shuffled(packed)
    joined = cv.withColumn("_p", F.coalesce(F.col(profile), F.lit(lx.GENERIC_PROFILE_ID))).join(
        dims.withColumnRenamed("profile_id", "_p"), "_p", "left")
    default = small_or_shuffled(packed.filter(F.col("profile_id") == lx.GENERIC_PROFILE_ID).select(
        F.col("profile_id").alias("_g"), F.col("criteria").alias("generic")))
    joined = joined.withColumn("_g", F.lit(lx.GENERIC_PROFILE_ID)).join(default, "_g", "left")

    def one(c):
        out = None
        for name in RULES:
            hit = c["rule"] == name
            res = rule_result(name, c["keywords"])
            out = F.when(hit, res) if out is None else out.when(hit, res)
        unknown = F.struct(F.lit(0).alias("score"), F.format_string(EVIDENCE["unknown"], c["rule"]).alias("evidence"))
        return F.struct(c.alias("c"), out.otherwise(unknown).alias("r"))

    rows = joined.select("doc_id", F.explode(F.transform(F.coalesce("criteria", "generic"), one)).alias("x"))
    return rows.select(
        "doc_id", F.col("x.c.ord").alias("ord"), F.col("x.c.criterion_id").alias("criterion_id"),
        F.col("x.c.label").alias("label"), F.col("x.c.weight").alias("weight"), F.col("x.c.required").alias("required"),
        F.col("x.r.score").alias("score"), F.col("x.r.evidence").alias("evidence"),
        (F.col("x.r.score") * F.col("x.c.weight") / 100).alias("weighted_score"))


def totals(results: DataFrame) -> DataFrame:
    """(doc_id, total, met, unmet_required, unmet_optional)."""
    return results.groupBy("doc_id").agg(
        F.sum("weighted_score").alias("total"), F.count_if(F.col("score") > 0).alias("met"),
        F.count_if((F.col("score") == 0) & F.col("required")).alias("unmet_required"),
        F.count_if((F.col("score") == 0) & ~F.col("required")).alias("unmet_optional"))


def unmet_brief(results: DataFrame) -> DataFrame:
    """(doc_id, required_unmet, optional_unmet): text lines in criterion order."""
    def lines(cond, text):
        return F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct(F.col("ord"), text.alias("t"))))),
                                        lambda x: x["t"]), "\n")

    req = F.concat(F.lit("- **"), "label", F.lit("** ("), F.col("weight").cast("string"), F.lit(" pts) : "), "evidence")
    opt = F.concat(F.lit("- "), "label", F.lit(" ("), F.col("weight").cast("string"), F.lit(" pts)"))
    zero = F.col("score") == 0
    return results.groupBy("doc_id").agg(lines(zero & F.col("required"), req).alias("required_unmet"),
                                         lines(zero & ~F.col("required"), opt).alias("optional_unmet"))

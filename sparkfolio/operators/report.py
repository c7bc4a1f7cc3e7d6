"""Report columns: bands, strength, strengths and improvements, recommendations, cards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio.functions import text as tx

REQUIRED_SECTIONS = ["experience", "education", "skills"]

# --- fixed values: report texts ---------------------------------------------------------------
SECTION_LABELS = {"experience": "Expérience professionnelle", "skills": "Compétences", "education": "Formation"}
STRENGTHS = {
    "skills": "Compétences techniques riches (%d skills détectés)",
    "role": "Expérience réelle (%s, %d an(s))",
    "years": "Expérience réelle (%d an(s))",
    "experience": "Expériences professionnelles présentes",
    "summary": "Accroche/profil présent",
    "metrics": "Métriques chiffrées dans les expériences",
    "projects": "%d projet(s) documenté(s)",
    "words": "CV bien développé (%d mots)",
}
IMPROVEMENTS = {
    "skills": "Enrichir les compétences techniques (%d détectées, cible ≥ 10)",
    "experience": "Ajouter une expérience professionnelle",
    "summary": "Ajouter une accroche/profil en tête de CV",
    "metrics": "Quantifier les résultats dans les expériences (%, chiffres, volumes)",
    "projects": "Créer une section Projets avec stack et résultats",
    "words": "Développer le contenu (%d mots détectés, cible ≥ 300)",
}
# name -> (priority, impact, action, why)
RECOMMENDATIONS = {
    "layout": (1, "Fort", "Convertir en 1 colonne", "Les parseurs ATS ignorent souvent la colonne droite — données perdues"),
    "section": (1, "Fort", "Ajouter une section « %s »", "Section obligatoire pour passer les filtres ATS automatiques"),
    "metrics": (2, "Moyen", "Ajouter des métriques chiffrées dans les expériences", "Différencie les profils à compétences équivalentes (%, volumes, délais)"),
    "projects": (2, "Moyen", "Créer une section Projets avec stack et résultats", "Signal fort de pratique autonome, très valorisé en tech"),
    "summary": (2, "Moyen", "Ajouter une accroche/profil en début de CV", "Aide les recruteurs à positionner rapidement votre profil"),
    "dates": (2, "Moyen", "Compléter les dates de début/fin dans les expériences", "Les ATS utilisent les dates pour calculer les années d'expérience"),
    "verbs": (3, "Faible", "Débuter les bullets par des verbes ou noms d'action", "Style attendu par les recruteurs (réalisé, développé, optimisé…)"),
    "skills": (3, "Faible", "Enrichir les compétences (%d détectées, cible ≥ 10)", "Plus de mots-clés techniques = meilleur taux de correspondance ATS"),
    "words": (3, "Faible", "Développer le contenu du CV (%d mots, cible ≥ 300)", "CV trop court — enrichir avec contexte et bullets détaillés"),
    "density": (3, "Faible", "Réduire la répétition de mots-clés techniques", "Densité actuelle %d%% — risque de sur-optimisation détectée par certains ATS"),
}


def level(score: Column) -> Column:
    return F.when(score >= 75, "Solide").when(score >= 50, "Correct").otherwise("À renforcer")


def score_colour(score: Column) -> Column:
    return F.when(score >= 70, "#22c55e").when(score >= 50, "#f59e0b").otherwise("#ef4444")


def score_light(score: Column) -> Column:
    return F.when(score >= 70, "🟢").when(score >= 45, "🟡").otherwise("🔴")


def _grouped(c: Column) -> Column:
    return F.replace(F.format_number(F.floor(c), 0), F.lit(","), F.lit(" "))


def pay_range(low: Column, high: Column) -> Column:
    """``lo – hi`` with thousands spaces, ? for a missing side, null without any figure."""
    lo, hi = F.coalesce(low, F.lit(0.0)) != 0, F.coalesce(high, F.lit(0.0)) != 0
    return F.when(lo | hi, F.concat(F.when(lo, _grouped(low)).otherwise("?"), F.lit(" – "),
                                    F.when(hi, _grouped(high)).otherwise("?")))


def card_meta(company: Column, location: Column, contract: Column) -> Column:
    return F.concat_ws(" · ", F.nullif(company, F.lit("")), F.nullif(location, F.lit("")), contract)


# --- one record -------------------------------------------------------------------------------
def detected_sections() -> Column:
    c = F.col
    return F.array_compact(F.array(
        F.when(F.coalesce(c("summary"), F.lit("")) != "", "summary"), F.when(F.size("experience") > 0, "experience"),
        F.when(F.size("education") > 0, "education"), F.when(F.size("skills_flat") > 0, "skills"),
        F.when(F.size("projects") > 0, "projects"), F.when(F.size("languages") > 0, "languages")))


def missing_sections() -> Column:
    return F.array_except(tx.lit_array(REQUIRED_SECTIONS), detected_sections())


def bullets_text() -> Column:
    return F.array_join(F.flatten(F.transform("experience", lambda e: e["bullets"])), " ")


def metric_text() -> Column:
    return F.concat(bullets_text(), F.array_join(F.flatten(F.transform("projects", lambda p: p["metrics"])), " "))


def has_metrics() -> Column:
    return tx.has_metric(metric_text())


def has_action_signal() -> Column:
    b = bullets_text()
    return tx.has_action_word(F.when(b != "", b).otherwise(F.col("raw_text")))


def has_dates() -> Column:
    n = F.size("experience")
    dated = F.size(F.filter("experience", lambda e: F.coalesce(e["date_start"], F.lit("")) != ""))
    return (n > 0) & (dated / F.greatest(n, F.lit(1)) >= 0.5)


def with_signals(cv):
    """Add total_skills, has_metrics, has_verbs, has_dates used by the report columns."""
    return (cv.withColumn("total_skills", F.size("skills_flat")).withColumn("has_metrics", has_metrics())
            .withColumn("has_verbs", has_action_signal()).withColumn("has_dates", has_dates()))


def strength_score() -> Column:
    c = F.col

    def pts(cond, n):
        return F.when(cond, n).otherwise(0)

    return F.least(F.lit(100), pts(c("word_count") >= 300, 15) + pts(c("total_skills") >= 10, 20)
                   + pts(F.size("experience") >= 1, 15) + pts(F.coalesce(c("summary"), F.lit("")) != "", 10)
                   + pts(c("has_dates"), 10) + pts(c("has_verbs"), 10) + pts(c("has_metrics"), 10)
                   + pts(F.size("projects") > 0, 10))


def readability_label(layout: Column) -> Column:
    return F.when(layout == "single_column", "✅ Optimal").otherwise("⚠️ Risque parseur")


def total_experience_years() -> Column:
    return F.round(F.aggregate("experience", F.lit(0), lambda a, e: a + F.coalesce(e["duration_months"], F.lit(0))) / 12, 1)


def most_recent_role() -> Column:
    e = F.get("experience", F.lit(0))
    return F.nullif(F.concat_ws(" @ ", F.nullif(e["title"], F.lit("")), F.nullif(e["company"], F.lit(""))), F.lit(""))


def _filled(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def strengths() -> Column:
    c, t = F.col, STRENGTHS
    years, role = total_experience_years(), most_recent_role()
    whole = F.bround(years, 0).cast("int")
    real = (F.when((years > 0) & role.isNotNull(), F.format_string(t["role"], role, whole))
            .when(years > 0, F.format_string(t["years"], whole)).otherwise(t["experience"]))
    return F.array_compact(F.array(
        F.when(c("total_skills") >= 10, F.format_string(t["skills"], c("total_skills"))),
        F.when(F.size("experience") >= 1, real),
        F.when(_filled("summary"), t["summary"]),
        F.when(c("has_metrics"), t["metrics"]),
        F.when(F.size("projects") > 0, F.format_string(t["projects"], F.size("projects"))),
        F.when(c("word_count") >= 300, F.format_string(t["words"], c("word_count")))))


def improvements() -> Column:
    c, t = F.col, IMPROVEMENTS
    return F.array_compact(F.array(
        F.when(c("total_skills") < 10, F.format_string(t["skills"], c("total_skills"))),
        F.when(F.size("experience") < 1, t["experience"]),
        F.when(~_filled("summary"), t["summary"]),
        F.when(~c("has_metrics"), t["metrics"]),
        F.when(F.size("projects") == 0, t["projects"]),
        F.when(c("word_count") < 300, F.format_string(t["words"], c("word_count")))))


def recommendations(density: Column) -> Column:
    """array<struct<priority,impact,action,why>> ordered by priority.

    ``density`` is the share of skill words in the text.
    """
    c = F.col
    worked = F.size("experience") > 0
    gone = missing_sections()

    def row(when: Column, name: str, action: Column | None = None, why: Column | None = None) -> Column:
        priority, impact, action_text, why_text = RECOMMENDATIONS[name]
        return F.when(when, F.struct(
            F.lit(priority).alias("priority"), F.lit(impact).alias("impact"),
            (F.lit(action_text) if action is None else action).alias("action"),
            (F.lit(why_text) if why is None else why).alias("why")))

    def count(name: str, column: str) -> Column:
        return F.format_string(RECOMMENDATIONS[name][2], c(column))

    percent = F.format_string(RECOMMENDATIONS["density"][3], F.bround(density * 100, 0).cast("int"))
    return F.array_compact(F.array(
        row(c("layout_detected") == "two_columns", "layout"),
        *[row(F.array_contains(gone, s), "section", F.lit(RECOMMENDATIONS["section"][2] % SECTION_LABELS[s])) for s in REQUIRED_SECTIONS],
        row(~c("has_metrics") & worked, "metrics"),
        row((F.size("projects") == 0) & worked, "projects"),
        row(~_filled("summary"), "summary"),
        row(~c("has_dates") & worked, "dates"),
        row(~c("has_verbs"), "verbs"),
        row(c("total_skills") < 10, "skills", count("skills", "total_skills")),
        row(c("word_count") < 300, "words", count("words", "word_count")),
        row(density > 0.35, "density", why=percent)))

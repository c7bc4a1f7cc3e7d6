"""Criteria, profile detection, vectors and group reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.catalog.hashing import vectors_sql
from sparkfolio.catalog.q_matching import DIMS, JD, SKILL_LIST, STRUCT, _embed
from sparkfolio.catalog.q_records import _BODY_LINES, CLEAN, HAS_METRICS, METRIC_TEXT, SIGNALS, WC
from sparkfolio.catalog.q_text import sql_values
from sparkfolio.catalog.registry import query
from sparkfolio.functions import text as tx
from sparkfolio.functions import vectors as vx
from sparkfolio.operators import criteria as cr
from sparkfolio.operators import matching as mt
from sparkfolio.operators import profiles as pf
from sparkfolio.operators import report as rp
from sparkfolio.operators import semantic as sm
from sparkfolio.operators import vectorjoin as vj

CV = ("cv_text",)
KEYWORDS = ["usine", "Hadoop", "python", "the"]


def _lst(words):
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_BASE = f"""b0 AS (SELECT *, {METRIC_TEXT} AS mt, {WC} AS wc, lower({CLEAN}) AS raw FROM cv_text),
  b1 AS (SELECT *, raw || ' ' || array_to_string({SKILL_LIST}, ' ') AS ck FROM b0)"""
_F = "list_filter(kws, lambda k: contains({0}, lower(k)))"
_PCT = "CAST(CAST(round_even({0} * 100, 0) AS INT) AS STRING) || '%'"
_QUAL = f"list_filter({_lst(lx.QUALIFICATION_WORDS)}, lambda k: contains(raw, k))"
# rule -> (met, evidence) on flat columns; kws is the keyword list
RULE_SQL = {
    "has_experience": ("n_exp >= 1", "CASE WHEN n_exp >= 1 THEN n_exp || ' expérience(s) détectée(s)' ELSE 'Aucune expérience détectée' END"),
    "has_education": ("n_edu >= 1", "CASE WHEN n_edu >= 1 THEN n_edu || ' formation(s) / diplôme(s) détecté(s)' ELSE 'Aucune formation détectée' END"),
    "has_summary": ("summary IS NOT NULL", "CASE WHEN summary IS NOT NULL THEN 'Accroche/profil présent' ELSE 'Accroche/profil absente' END"),
    "has_dates": ("n_exp >= 1", "CASE WHEN n_exp >= 1 THEN n_exp || '/' || n_exp || ' expériences datées (100%)' ELSE 'Aucune expérience — dates non vérifiables' END"),
    "has_sufficient_words": ("wc >= 300", "wc || ' mots détectés (seuil : 300)'"),
    "has_contact": ("email IS NOT NULL OR phone IS NOT NULL", """CASE WHEN email IS NULL AND phone IS NULL THEN 'Ni email ni téléphone détectés'
        ELSE concat_ws(' | ', CASE WHEN email IS NOT NULL THEN 'Email détecté' END, CASE WHEN phone IS NOT NULL THEN 'Téléphone détecté' END) END"""),
    "has_tech_skills": ("n_skill >= 5", "n_skill || ' compétences techniques détectées'"),
    "has_sector_skills": (f"CASE WHEN len(kws) = 0 THEN n_skill >= 3 ELSE len({_F.format('ck')}) >= 1 END",
        f"CASE WHEN len(kws) = 0 THEN n_skill || ' compétences sectorielles' WHEN len({_F.format('ck')}) > 0 THEN 'Mots-clés trouvés : ' || array_to_string({_F.format('ck')}, ', ') ELSE 'Aucun mot-clé sectoriel détecté' END"),
    "has_metrics": (HAS_METRICS, f"CASE WHEN {HAS_METRICS} THEN 'Métriques chiffrées présentes' ELSE 'Aucune métrique chiffrée détectée' END"),
    "has_projects": ("n_proj >= 1", "CASE WHEN n_proj >= 1 THEN n_proj || ' projet(s) documenté(s)' ELSE 'Aucun projet documenté' END"),
    "has_profile_keywords": (f"len(kws) > 0 AND len({_F.format('ck')}) / greatest(len(kws), 1) >= 0.3",
        f"CASE WHEN len(kws) = 0 THEN 'Aucun mot-clé métier configuré' ELSE len({_F.format('ck')}) || '/' || len(kws) || ' mots-clés métier (' || {_PCT.format(f'(len({_F.format(chr(99) + chr(107))}) / greatest(len(kws), 1))')} || ')' END"),
    "has_habilitations": (f"len({_QUAL}) >= 1", f"CASE WHEN len({_QUAL}) >= 1 THEN 'Habilitations trouvées : ' || array_to_string(list_slice({_QUAL}, 1, 5), ', ') ELSE 'Aucune habilitation détectée' END"),
    "has_languages": ("n_lang >= 1", "CASE WHEN n_lang >= 1 THEN n_lang || ' langue(s) détectée(s)' ELSE 'Aucune langue étrangère détectée' END"),
    "has_ai_criterion": (f"len({_F.format('raw')}) >= 1", f"""CASE WHEN len(kws) = 0 THEN 'Aucun mot-clé configuré' WHEN len({_F.format('raw')}) > 0
        THEN 'Mots-clés trouvés : ' || array_to_string({_F.format('raw')}, ', ') ELSE 'Aucun mot-clé détecté dans le CV' END"""),
}


def _register_rule(name):
    met, evidence = RULE_SQL[name]

    @query("crit_" + name, f"""WITH {_BASE}, k AS (SELECT *, {_lst(KEYWORDS)} AS kws FROM b1)
       SELECT doc_id, CASE WHEN {met} THEN 100 ELSE 0 END AS score, {evidence} AS evidence FROM k""", uses=CV)
    def _(t):
        return t.cv.select("doc_id", cr.rule_result(name, tx.lit_array(KEYWORDS)).alias("r")).select("doc_id", "r.score", "r.evidence")


for _name in RULE_SQL:
    _register_rule(_name)

@cr.rule("two_degrees")
def _two_degrees(_keywords):
    """A rule as a user adds it."""
    n = F.size("education")
    return n >= 2, F.when(n >= 2, F.format_string("%d diplômes", n)).otherwise("moins de deux diplômes")


@query("udf2_custom_criterion", """SELECT doc_id, CASE WHEN n_edu >= 2 THEN 100 ELSE 0 END AS score, CASE WHEN n_edu >= 2 THEN n_edu || ' diplômes' ELSE 'moins de deux diplômes' END AS evidence
   FROM cv_flat""", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", cr.rule_result("two_degrees", tx.lit_array([])).alias("r")).select("doc_id", "r.score", "r.evidence")


# --- profiles: a small catalogue, stated alike on both sides ----------------------------------
CATALOGUE = [
    pf.Profile("ml_engineer", "Informatique & Digital", "Machine Learning Engineer", ["ml engineer"], ["machine learning", "python", "docker", "spark", "kafka"], "informatique_digital"),
    pf.Profile("conseiller_vente", "Commerce & Distribution", "Conseiller de vente", ["vendeur"], ["magasin", "crm", "vendeur", "team"], "commerce_distribution"),
    pf.Profile("operateur_production", "Industrie & Fabrication", "Opérateur de production", ["agent de production"], ["usine", "costs", "technicien"], "industrie_manufacturiere"),
    pf.Profile("data_analyst", "Informatique & Digital", "Data analyst", ["analyste"], ["sql", "power bi", "analyst", "git"], "informatique_digital"),
    pf.Profile("traducteur", "Culture & Médias", "Traducteur", ["translator"], ["the", "que", "und"], "culture_medias"),
]
_PK = f"pk AS (SELECT * FROM {sql_values([(p.profile_id, p.sector, p.job_title, i, k) for i, p in enumerate(CATALOGUE) for k in p.keywords], 'profile_id, sector, job_title, ord, keyword')})"
_EXPTXT = rf"""lower(concat_ws(' ', CASE WHEN n_exp >= 1 THEN array_to_string({_BODY_LINES}, ' ') || ' ' || e1_title || ' — ' || e1_company END,
   CASE WHEN n_exp >= 2 THEN e2_bullet || ' ' || e2_title || ' — ' || e2_company END, CASE WHEN n_exp >= 3 THEN e3_title || ' — ' || e3_company END))"""
_PROFILE_TEXTS = f"""tx AS (SELECT doc_id, lower(array_to_string({SKILL_LIST}, ' ') || ' ' || array_to_string({SKILL_LIST}, ', ')) AS sk,
     CASE WHEN n_exp >= 1 THEN {_EXPTXT} ELSE lower({CLEAN}) END AS ex FROM cv_text)"""
_PS = f"""{_PK}, {_PROFILE_TEXTS},
   ps AS (SELECT doc_id, profile_id, sector, job_title, ord, avg(CASE WHEN contains(sk, keyword) THEN 1.0 ELSE 0.0 END) AS s_skills,
     avg(CASE WHEN contains(ex, keyword) THEN 1.0 ELSE 0.0 END) AS s_exp FROM tx, pk GROUP BY ALL)"""
_CEN = """cen AS (SELECT label, list(m ORDER BY p) AS cv FROM (SELECT label, p, avg(v::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS p FROM embeddings) GROUP BY label, p) GROUP BY label)"""
_PID = "CASE c.label " + " ".join(f"WHEN {i} THEN '{p.profile_id}'" for i, p in enumerate(CATALOGUE)) + " END"
_TS = f"{_CEN}, ts AS (SELECT vec_id AS doc_id, {_PID} AS profile_id, list_cosine_similarity(e.embedding::DOUBLE[], c.cv) AS s_title FROM embeddings e, cen c WHERE c.label < {len(CATALOGUE)})"


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _centroids(t):
    return vj.centroids(t.embeddings, "label", "embedding").select(F.col("label").cast("bigint").alias("phrase"), "vector")


def _title_scores(t):
    """map profile -> title similarity per record; aliases are the label centroids."""
    sims = vj.similarity_maps(_vectors(t), _centroids(t))
    pairs = F.array(*[F.struct(F.lit(p.profile_id), F.element_at("sims", F.lit(i).cast("bigint"))) for i, p in enumerate(CATALOGUE)])
    return sims.select(F.col("id").alias("doc_id"), F.map_from_entries(pairs).alias("title_scores"))


@query("j3_profile_keyword_coverage", f"WITH {_PS} SELECT doc_id, profile_id, round(s_skills, 6) AS s_skills, round(s_exp, 6) AS s_exp FROM ps", uses=CV)
def _(t):
    return pf.profile_coverage(t.cv, CATALOGUE).select("doc_id", "profile_id", F.round("skills", 6).alias("s_skills"), F.round("exp", 6).alias("s_exp"))


_RANKED = f"""{_PS}, {_TS}, sc AS (SELECT ps.*, 0.4 * coalesce(s_title, 0) + 0.35 * s_skills + 0.25 * s_exp AS score FROM ps LEFT JOIN ts USING (doc_id, profile_id)),
   rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, ord) AS r FROM sc)"""


@query("a8_profile_score", f"WITH {_RANKED} SELECT doc_id, profile_id, round(score, 4) AS score FROM sc", uses=CV)
def _(t):
    cv = t.cv.join(_title_scores(t), "doc_id", "left")
    return pf.profile_coverage(cv, CATALOGUE, F.col("title_scores")).select("doc_id", "profile_id", F.round("score", 4).alias("score"))


_BEST = f"""{_RANKED}, bs AS (SELECT doc_id, profile_id, sector, job_title, least(1.0, greatest(0.0, score)) AS conf FROM rk WHERE r = 1)"""


@query("m2_detect_profile", f"""WITH {_BEST} SELECT doc_id, CASE WHEN conf >= 0.3 THEN profile_id ELSE 'non_detecte' END AS profile_id, CASE WHEN conf >= 0.3 THEN sector ELSE 'Générique' END AS sector,
   CASE WHEN conf >= 0.3 THEN job_title ELSE 'Non détecté' END AS job_title, round(conf, 3) AS confidence FROM bs""", uses=CV)
def _(t):
    cv = t.cv.join(_title_scores(t), "doc_id", "left")
    return pf.detect(cv, CATALOGUE, F.col("title_scores")).drop("alternatives")


# A catalogue that grows with the tables: one profile for each part.
_PARTS = """SELECT p_partkey AS ord, 'part_' || CAST(p_partkey AS VARCHAR) AS profile_id, p_brand AS sector, p_name AS job_title,
   lower(split_part(p_name, ' ', 1)) AS k1, lower(split_part(p_name, ' ', 2)) AS k2, lower(p_type) AS k3, lower(p_brand) AS k4 FROM part"""


@query("m2_large_catalogue", f"""WITH pf AS ({_PARTS}), pk AS (SELECT ord, profile_id, sector, job_title, unnest([k1, k2, k3, k4]) AS keyword FROM pf), {_PROFILE_TEXTS},
   kd AS (SELECT doc_id, keyword, CASE WHEN contains(sk, keyword) THEN 1.0 ELSE 0.0 END AS a, CASE WHEN contains(ex, keyword) THEN 1.0 ELSE 0.0 END AS b
     FROM tx CROSS JOIN (SELECT DISTINCT keyword FROM pk)),
   sc AS (SELECT doc_id, ord, profile_id, sector, job_title, sum(a) / 4 * 0.35 + sum(b) / 4 * 0.25 AS score FROM kd JOIN pk USING (keyword) GROUP BY ALL),
   rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, ord) AS r FROM sc),
   al AS (SELECT doc_id, string_agg(profile_id, ',' ORDER BY r) AS others FROM (SELECT *, max(CASE WHEN r = 1 AND score >= 0.3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS sure FROM rk)
     WHERE r BETWEEN 1 + sure AND 3 + sure GROUP BY doc_id)
   SELECT rk.doc_id, CASE WHEN score >= 0.3 THEN profile_id ELSE 'non_detecte' END AS profile_id, CASE WHEN score >= 0.3 THEN job_title ELSE 'Non détecté' END AS job_title,
     round(score, 3) AS confidence, others FROM rk JOIN al USING (doc_id) WHERE r = 1""", uses=CV)
def _(t):
    keywords = "array(lower(split_part(p_name, ' ', 1)), lower(split_part(p_name, ' ', 2)), lower(p_type), lower(p_brand)) AS keywords"
    parts = t.part.selectExpr("p_partkey AS ord", "concat('part_', p_partkey) AS profile_id", "p_brand AS sector", "p_name AS job_title", keywords)
    d = pf.detect(t.cv, parts)
    return d.select("doc_id", "profile_id", "job_title", "confidence", F.array_join(F.transform("alternatives", lambda a: a["id"]), ",").alias("others"))


@query("w9_profile_alternatives", f"""WITH {_BEST} SELECT rk.doc_id, string_agg(rk.profile_id || ':' || CAST(CAST(round(score * 1000) AS INT) AS STRING), ',' ORDER BY r) AS alternatives FROM rk JOIN bs USING (doc_id)
   WHERE r BETWEEN CASE WHEN conf >= 0.3 THEN 2 ELSE 1 END AND CASE WHEN conf >= 0.3 THEN 4 ELSE 3 END GROUP BY rk.doc_id""", uses=CV)
def _(t):
    cv = t.cv.join(_title_scores(t), "doc_id", "left")
    d = pf.detect(cv, CATALOGUE, F.col("title_scores"))
    return d.select("doc_id", F.array_join(F.transform("alternatives", lambda a: F.concat(a["id"], F.lit(":"), F.round(a["score"] * 1000).cast("int").cast("string"))), ",").alias("alternatives"))


_CHOICE = "CASE lang WHEN 'fr' THEN 'conseiller_vente' WHEN 'de' THEN 'nope' ELSE 'ml_engineer' END"


@query("p23_manual_profile", f"""SELECT doc_id, CASE lang WHEN 'fr' THEN 'conseiller_vente' WHEN 'de' THEN 'non_detecte' ELSE 'ml_engineer' END AS profile_id,
   CASE lang WHEN 'fr' THEN 'Conseiller de vente' WHEN 'de' THEN 'Non détecté' ELSE 'Machine Learning Engineer' END AS job_title, 1.0 AS confidence FROM documents""")
def _(t):
    return t.documents.select("doc_id", pf.forced(F.expr(_CHOICE), CATALOGUE).alias("p")).select("doc_id", "p.profile_id", "p.job_title", "p.confidence")


@query("e19_title_windows", """WITH w AS (SELECT doc_id, e1_title || ' ' || e1_company AS full_title, string_split(e1_title || ' ' || e1_company, ' ') AS ws FROM cv_flat),
   i AS (SELECT *, unnest([2, 3, 4]) AS n FROM w), j AS (SELECT *, unnest(range(1, len(ws) - n + 2)) AS s FROM i)
   SELECT doc_id, full_title AS win FROM w UNION ALL SELECT doc_id, array_to_string(ws[s:s + n - 1], ' ') FROM j""", uses=("cv_flat",))
def _(t):
    return t.cv_flat.select("doc_id", F.explode(tx.title_windows(F.concat_ws(" ", "e1_title", "e1_company"))).alias("win"))


# --- criteria over profiles -------------------------------------------------------------------
def _profile_rows(t):
    return t.spark.createDataFrame([(p.profile_id, p.sector_key, p.keywords) for p in CATALOGUE], "profile_id string, sector_key string, keywords array<string>")


def _criteria(t):
    templates, overrides = cr.templates_frame(t.spark)
    return cr.build_criteria(_profile_rows(t), templates, overrides, cr.definitions_frame(t.spark))


def _spec(p):
    return lx.PROFILE_OVERRIDES.get(p.profile_id) or lx.SECTOR_TEMPLATES[p.sector_key]


_CRIT_ROWS = [(p.profile_id, i, cid, lx.CRITERION_DEFS[cid][0], lx.CRITERION_DEFS[cid][1], w, r, "|".join(p.keywords if cid == "eval_profile_keywords" else lx.CRITERION_DEFS[cid][2]))
              for p in CATALOGUE for i, (cid, w, r) in enumerate(_spec(p))]
_GEN_ROWS = [("non_detecte", i, cid, label, fn, w, r, "|".join(k)) for i, (cid, label, w, r, fn, k) in enumerate(lx.GENERIC_CRITERIA)]
_CRIT = f"cc AS (SELECT * FROM {sql_values(_CRIT_ROWS + _GEN_ROWS, 'profile_id, ord, criterion_id, label, rule, weight, required, kw')})"
_ASSIGN = "CASE lang WHEN 'fr' THEN 'conseiller_vente' WHEN 'de' THEN NULL WHEN 'es' THEN 'gone' ELSE CASE WHEN n_chars % 2 = 0 THEN 'ml_engineer' ELSE 'operateur_production' END END"
_MET = "CASE rule " + " ".join(f"WHEN '{n}' THEN {m}" for n, (m, _e) in RULE_SQL.items()) + " END"
_EVI = "CASE rule " + " ".join(f"WHEN '{n}' THEN {e}" for n, (_m, e) in RULE_SQL.items()) + " END"
_EVAL = f"""{_CRIT}, {_BASE}, b2 AS (SELECT b1.*, cc.*, CASE WHEN kw = '' THEN [] ELSE string_split(kw, '|') END AS kws FROM (SELECT *, {_ASSIGN} AS pid FROM b1) b1
     JOIN cc ON cc.profile_id = CASE WHEN pid IN ('conseiller_vente', 'ml_engineer', 'operateur_production') THEN pid ELSE 'non_detecte' END),
   ev AS (SELECT doc_id, profile_id, ord, criterion_id, label, weight, required, CASE WHEN {_MET} THEN 100 ELSE 0 END AS score, {_EVI} AS evidence FROM b2)"""


def _evaluated(t):
    cv = t.cv.join(t.documents.select("doc_id", F.expr(_ASSIGN).alias("profile_id")), "doc_id")
    return cr.evaluate(cv, _criteria(t))


@query("m6_evaluate_criteria", f"WITH {_EVAL} SELECT doc_id, criterion_id, score, evidence, score * weight / 100 AS weighted FROM ev", uses=CV)
def _(t):
    return _evaluated(t).select("doc_id", "criterion_id", "score", "evidence", F.col("weighted_score").alias("weighted"))


@query("j4_criterion_join", f"WITH {_EVAL} SELECT doc_id, ord, criterion_id, label, weight, required FROM ev", uses=CV)
def _(t):
    return _evaluated(t).select("doc_id", "ord", "criterion_id", "label", "weight", "required")


@query("a12_weighted_total", f"""WITH {_EVAL} SELECT doc_id, sum(score * weight / 100) AS total, count(*) FILTER (WHERE score > 0) AS met, count(*) FILTER (WHERE score = 0 AND required) AS unmet_required,
   count(*) FILTER (WHERE score = 0 AND NOT required) AS unmet_optional FROM ev GROUP BY doc_id""", uses=CV)
def _(t):
    return cr.totals(_evaluated(t))


@query("e33_unmet_brief", f"""WITH {_EVAL} SELECT doc_id, coalesce(string_agg('- **' || label || '** (' || weight || ' pts) : ' || evidence, chr(10) ORDER BY ord) FILTER (WHERE score = 0 AND required), '') AS required_unmet,
   coalesce(string_agg('- ' || label || ' (' || weight || ' pts)', chr(10) ORDER BY ord) FILTER (WHERE score = 0 AND NOT required), '') AS optional_unmet FROM ev GROUP BY doc_id""", uses=CV)
def _(t):
    return cr.unmet_brief(_evaluated(t))


_TPL = sql_values([(k, i, c, w, r) for k, v in lx.SECTOR_TEMPLATES.items() for i, (c, w, r) in enumerate(v)], "sector_key, ord, criterion_id, weight, required")
_OVR = sql_values([(k, i, c, w, r) for k, v in lx.PROFILE_OVERRIDES.items() for i, (c, w, r) in enumerate(v)], "profile_id, ord, criterion_id, weight, required")
_PART_SECTORS = "CASE p_type WHEN 'ECONOMY' THEN 'btp' WHEN 'SMALL' THEN 'sport' WHEN 'MEDIUM' THEN 'informatique_digital' WHEN 'PROMO' THEN 'securite' WHEN 'STANDARD' THEN 'immobilier' ELSE 'artisanat' END"
_PART_PROFILE = "CASE WHEN p_size = 7 THEN 'infirmier' ELSE 'part_' || CAST(p_partkey AS STRING) END"


def _part_profiles(t):
    return t.part.select(F.expr(_PART_PROFILE).alias("profile_id"), F.expr(_PART_SECTORS).alias("sector_key"), "p_partkey", F.split("p_name", " ").alias("keywords")).groupBy("profile_id").agg(
        F.min(F.struct("sector_key", "p_partkey", "keywords")).alias("p")).select(
        "profile_id", "p.sector_key", "p.keywords", F.col("p.sector_key").alias("sector"))


_PP = f"pp AS (SELECT profile_id, min(sector_key) AS sector_key FROM (SELECT {_PART_PROFILE} AS profile_id, {_PART_SECTORS} AS sector_key FROM part) GROUP BY profile_id)"
_J12 = f"""{_PP}, tp AS (SELECT * FROM {_TPL}), ov AS (SELECT * FROM {_OVR}), jc AS (SELECT pp.profile_id, o.ord, o.criterion_id, o.weight, o.required FROM pp JOIN ov o ON o.profile_id = pp.profile_id
   UNION ALL SELECT pp.profile_id, t.ord, t.criterion_id, t.weight, t.required FROM pp JOIN tp t ON t.sector_key = pp.sector_key WHERE pp.profile_id NOT IN (SELECT profile_id FROM ov))"""


def _part_criteria(t):
    templates, overrides = cr.templates_frame(t.spark)
    return cr.build_criteria(_part_profiles(t), templates, overrides, cr.definitions_frame(t.spark))


@query("j12_template_override", f"WITH {_J12} SELECT profile_id, ord, criterion_id, weight, required FROM jc")
def _(t):
    return _part_criteria(t).select("profile_id", "ord", "criterion_id", "weight", "required")


@query("m10_build_criteria", f"WITH {_J12} SELECT profile_id, count(*) AS criteria, CAST(sum(weight) AS BIGINT) AS total FROM jc GROUP BY profile_id")
def _(t):
    return _part_criteria(t).groupBy("profile_id").agg(F.count("*").alias("criteria"), F.sum("weight").alias("total"))


@query("a15_weight_validation", """SELECT p_brand AS profile_id, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY p_brand HAVING sum(p_size) <> 100""")
def _(t):
    return cr.weight_errors(t.part.select(F.col("p_brand").alias("profile_id"), F.col("p_size").alias("weight")))


@query("s8_profile_dimension", f"SELECT profile_id, sector_key AS sector FROM (SELECT {_PART_PROFILE} AS profile_id, min({_PART_SECTORS}) AS sector_key FROM part GROUP BY 1)")
def _(t):
    return _part_profiles(t).select("profile_id", "sector")


@query("a24_profiles_per_sector", f"SELECT sector, count(*) AS profiles, string_agg(profile_id, ',' ORDER BY profile_id) AS ids FROM (SELECT DISTINCT {_PART_SECTORS} AS sector, p_brand AS profile_id FROM part) GROUP BY sector")
def _(t):
    from sparkfolio.sources.profiles import profiles_by_sector
    p = t.part.select(F.expr(_PART_SECTORS).alias("sector"), F.col("p_brand").alias("profile_id"))
    return profiles_by_sector(p).select("sector", F.size("profile_ids").alias("profiles"), F.array_join("profile_ids", ",").alias("ids"))


# --- vectors ----------------------------------------------------------------------------------
@query("e23_clipped_cosine", f"WITH {_CEN} SELECT vec_id, round(least(1.0, greatest(0.0, list_cosine_similarity(e.embedding::DOUBLE[], c.cv))), 5) AS cosine FROM embeddings e JOIN cen c ON c.label = e.label")
def _(t):
    c = vj.centroids(t.embeddings, "label", "embedding")
    return t.embeddings.join(c, "label").select("vec_id", F.round(vx.clipped_cosine(F.col("embedding"), F.col("vector")), 5).alias("cosine"))


_SIM = f"{_CEN}, sm AS (SELECT e.vec_id, e.label AS owner, c.label AS phrase, list_cosine_similarity(e.embedding::DOUBLE[], c.cv) AS sim FROM embeddings e, cen c), bp AS (SELECT owner, phrase, max(sim) AS sim FROM sm GROUP BY owner, phrase)"


@query("j6_vector_similarity_join", f"WITH {_SIM} SELECT vec_id, phrase, round(sim, 5) AS sim FROM sm WHERE sim >= 0.3")
def _(t):
    return vj.similar_pairs(_vectors(t), _centroids(t), 0.3).select(F.col("id").alias("vec_id"), "phrase", F.round("sim", 5).alias("sim"))


@query("j6_vector_similarity_blocks", f"WITH {_SIM} SELECT vec_id, phrase, round(sim, 5) AS sim FROM sm WHERE sim >= 0.3")
def _(t):
    return vj.similar_pairs(_vectors(t), _centroids(t), 0.3, max_broadcast=1).select(F.col("id").alias("vec_id"), "phrase", F.round("sim", 5).alias("sim"))


def _best(t):
    return vj.best_per_phrase(t.embeddings.select(F.col("label").alias("owner"), F.col("embedding").alias("vector")), _centroids(t))


@query("a9_best_similarity", f"WITH {_SIM} SELECT owner, phrase, round(sim, 5) AS sim FROM bp")
def _(t):
    return _best(t).select("owner", "phrase", F.round("sim", 5).alias("sim"))


_LINES = r"""ln AS (SELECT doc_id, regexp_replace(unnest(regexp_split_to_array(text, '\r\n|[\n\r\x0B\f]')), '^[ \t]+|[ \t]+$', '', 'g') AS txt FROM documents),
   lt AS (SELECT doc_id, txt FROM ln WHERE len(regexp_extract_all(replace(txt, chr(160), ' '), '\S+')) >= 2)"""


@query("m1_semantic_skills", f"""WITH {_LINES}, {vectors_sql("lt", DIMS, name="lv", kind="DOUBLE")}, {vectors_sql("(SELECT text AS txt FROM benchmark)", DIMS, 256, name="pv")},
   bl AS (SELECT md5(l.txt) AS line, b.item_id, list_cosine_similarity(lv.vec, list_transform(pv.vec, lambda x: CAST(x AS DOUBLE))) AS sim FROM (SELECT DISTINCT txt FROM lt) l JOIN lv ON lv.tid = md5(l.txt)
     CROSS JOIN benchmark b JOIN pv ON pv.tid = md5(b.text)),
   bh AS (SELECT doc_id, item_id, max(sim) AS sim FROM lt JOIN bl ON bl.line = md5(lt.txt) WHERE sim >= 0.51 GROUP BY ALL)
   SELECT doc_id, item_id AS phrase, round(sim, 5) AS sim FROM bh""")
def _(t):
    phrases = t.benchmark.select(F.col("item_id").cast("bigint").alias("phrase"), "text")
    return sm.semantic_skills_from_text(t.documents, phrases, 0.51, _embed).select(F.col("owner").alias("doc_id"), "phrase", F.round("sim", 5).alias("sim"))


@query("a21_threshold_sweep", f"""WITH {_SIM}, th AS (SELECT owner, sim, unnest([0.45, 0.50, 0.55, 0.60, 0.65, 0.70]) AS threshold FROM bp),
   n AS (SELECT owner, threshold, count(*) FILTER (WHERE sim >= threshold) AS n FROM th GROUP BY owner, threshold)
   SELECT threshold, CASE WHEN owner < 6 THEN 'hf' ELSE 'synth' END AS corpus, count(*) AS owners, round(avg(n), 1) AS avg_matches, CAST(sum(CASE WHEN owner >= 8 THEN n ELSE 0 END) AS BIGINT) AS false_positives FROM n GROUP BY ALL""")
def _(t):
    return vj.threshold_sweep(_best(t), F.when(F.col("owner") < 6, "hf").otherwise("synth"), F.col("owner") >= 8)


@query("s15_vector_cache", f"""WITH {_CEN}, v AS (SELECT label, unnest(cv) AS v, generate_subscripts(cv, 1) - 1 AS place FROM cen)
   SELECT label AS phrase, place, round(CAST(CAST(v AS FLOAT) AS DOUBLE), 6) AS value, label % 2 = 0 AS from_cache, 0 AS computed_again FROM v""")
def _(t):
    from sparkfolio.session import scratch_dir
    from sparkfolio.sources.vector_store import VectorStore
    fresh = _centroids(t).select(F.col("phrase").cast("string").alias("key"), "vector")
    store = VectorStore(t.spark, scratch_dir(t.spark, "vectors"))
    compute = lambda lacking: lacking.select("key").join(fresh, "key")
    wanted = t.embeddings.select(F.col("label").cast("string").alias("key")).distinct()
    store.ensure(wanted.filter("key % 2 = 0"), compute)  # what an earlier run has left
    held = store.read().select("key").withColumn("from_cache", F.lit(True))
    store.ensure(wanted, compute)
    again = store.ensure(wanted, compute)
    found = store.read().join(held, "key", "left").select(F.col("key").cast("bigint").alias("phrase"), "from_cache", F.posexplode("vector").alias("place", "value"))
    return found.select("phrase", "place", F.round(F.col("value").cast("double"), 6).alias("value"), F.coalesce("from_cache", F.lit(False)).alias("from_cache"), F.lit(again).alias("computed_again"))


@query("m3_score_pairs", f"""WITH {JD}, nl AS (SELECT count(*) AS n FROM listing), pr AS (SELECT c.doc_id, l.listing_id, c.text AS raw, l.description FROM cv_text c
     JOIN listing l ON l.listing_id = 1 + c.doc_id % (SELECT n FROM nl)),
   dx AS (SELECT raw AS txt FROM pr UNION SELECT description FROM pr), {vectors_sql("dx", DIMS, 256)},
   pk AS MATERIALIZED (SELECT doc_id, md5(raw) AS x, md5(description) AS y FROM pr),
   sm AS (SELECT doc_id, list_inner_product(a.vec, b.vec) AS sim FROM pk JOIN hv a ON a.tid = x JOIN hv b ON b.tid = y),
   p AS (SELECT c.doc_id, pr.listing_id, least(1.0, coalesce(sim, 0.0)) AS sem, {STRUCT} AS st, coalesce((SELECT avg(CASE WHEN contains(lower(c.text), jk.w) THEN 1.0 ELSE 0.0 END) FROM jk WHERE jk.listing_id = pr.listing_id), 0.5) AS kw
     FROM cv_text c JOIN pr USING (doc_id) LEFT JOIN sm USING (doc_id))
   SELECT doc_id, listing_id, round(sem * 100, 1) AS semantic_similarity, round(kw * 100, 1) AS keyword_match, round(st * 100, 1) AS structure_completeness, round(sem * 35 + kw * 40 + st * 25, 1) AS overall FROM p""", uses=("cv_text", "listing"))
def _(t):
    from sparkfolio.sources.listings import source_order
    n = t.part.count()  # one listing for each record, dealt round
    pairs = t.documents.select("doc_id", (1 + F.col("doc_id") % n).alias("listing_id")).join(t.listing.select("listing_id", "source"), "listing_id").select(
        "doc_id", "listing_id", "source", F.lit(0).alias("query_ord"), source_order(F.col("source")).alias("source_ord"), F.lit(1).alias("r"), F.lit(1).cast("bigint").alias("shown"))
    s = mt.score_candidates(t.cv, pairs, t.listing, sm.pair_similarity(pairs, t.cv, t.listing, _embed))
    return s.select("doc_id", "listing_id", F.round(F.col("semantic") * 100, 1).alias("semantic_similarity"), F.round(F.col("keyword") * 100, 1).alias("keyword_match"),
                    F.round(F.col("structure") * 100, 1).alias("structure_completeness"), "overall")


# --- group reports ----------------------------------------------------------------------------
_AFTER = f"""{_EVAL}, {SIGNALS}, af AS (SELECT doc_id, sum(score * weight / 100) AS after FROM ev GROUP BY doc_id),
   br AS (SELECT ss.doc_id, CASE lang WHEN 'en' THEN 'tech' WHEN 'fr' THEN 'non-tech' ELSE 'other' END AS grp, strength AS before, CAST(floor(after) AS INT) AS after, lang IN ('en', 'fr') AS detected FROM ss JOIN af USING (doc_id))"""


def _bench(t):
    after = cr.totals(_evaluated(t)).select("doc_id", F.floor("total").cast("int").alias("after"))
    before = rp.with_signals(t.cv).select("doc_id", rp.strength_score().alias("before"))
    grp = t.documents.select("doc_id", F.expr("CASE lang WHEN 'en' THEN 'tech' WHEN 'fr' THEN 'non-tech' ELSE 'other' END").alias("grp"), F.col("lang").isin("en", "fr").alias("detected"))
    return before.join(after, "doc_id").join(grp, "doc_id")


@query("a19_group_report", f"""WITH {_AFTER} SELECT coalesce(grp, 'TOTAL') AS grp, count(*) AS n, round(avg(before), 1) AS avg_before, round(avg(after), 1) AS avg_after, round(avg(after - before), 1) AS avg_delta,
   count(*) FILTER (WHERE detected) AS detected FROM br GROUP BY GROUPING SETS ((grp), ())""", uses=CV)
def _(t):
    from sparkfolio.plans.groups import group_report
    return group_report(_bench(t))


@query("a20_detection_checks", f"""WITH {_AFTER} SELECT round(100.0 * count(*) FILTER (WHERE detected) / count(*), 0) AS detected_pct, round(avg(after) FILTER (WHERE grp = 'non-tech'), 1) AS non_tech_avg,
   avg(after) FILTER (WHERE grp = 'non-tech') >= 50 AS non_tech_ok, count(*) FILTER (WHERE grp = 'tech' AND after - before < -10) AS tech_regressions FROM br""", uses=CV)
def _(t):
    from sparkfolio.plans.groups import detection_checks
    return detection_checks(_bench(t))

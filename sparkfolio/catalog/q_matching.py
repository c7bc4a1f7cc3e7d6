"""Listing sources, search queries, scoring and ranking."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.catalog.hashing import vectors_sql
from sparkfolio.catalog.q_text import FOLD, STOPS, sql_values
from sparkfolio.catalog.registry import query
from sparkfolio.functions import contact, search
from sparkfolio.functions.embedding import hashed_embedding
from sparkfolio.operators import matching as mt
from sparkfolio.operators import records
from sparkfolio.sources import listings as ls

COLOR = {n: c for n, c in lx.LISTING_SOURCES}


# --- payload sources: each part row is stated as a raw payload with two items ------------------
def _payloads(t, source):
    p = t.listing
    if source == "adzuna":
        item = F.struct(F.concat(F.lit(" "), "title").alias("title"), F.struct(F.col("company").alias("display_name")).alias("company"),
                        F.struct(F.col("location").alias("display_name")).alias("location"), "description",
                        F.col("url").alias("redirect_url"), "salary_min", "salary_max", "contract_type")
        bare = F.struct("title", F.lit(None).cast("struct<display_name:string>").alias("company"),
                        F.lit(None).cast("struct<display_name:string>").alias("location"), F.lit(None).cast("string").alias("description"),
                        F.lit(None).cast("string").alias("redirect_url"), F.lit(None).cast("double").alias("salary_min"),
                        F.lit(None).cast("double").alias("salary_max"), F.lit(None).cast("string").alias("contract_type"))
        body = F.struct(F.array(item, bare).alias("results"))
    elif source == "jooble":
        pay = F.when(F.col("salary_max").isNull(), "Negotiable").otherwise(F.concat(
            (F.lit(40) + F.col("listing_id") % 50).cast("string"), F.lit(" "),
            F.lpad((F.col("listing_id") % 1000).cast("string"), 3, "0"), F.lit(" - 95 000 EUR")))
        item = F.struct("title", "location", F.col("description").alias("snippet"), pay.alias("salary"), "company",
                        F.col("url").alias("link"), F.col("contract_type").alias("type"))
        body = F.struct(F.array(item).alias("jobs"))
    else:
        pay = F.concat(F.lit("Mensuel de "), (F.lit(2000) + F.col("listing_id") % 900).cast("string"), F.lit(",5 Euros à 3100.0 Euros"))
        item = F.struct(F.col("title").alias("intitule"), F.struct(F.when(F.col("contract_type").isNotNull(), F.col("company"))
                        .otherwise(F.lit(" ")).alias("nom")).alias("entreprise"),
                        F.struct(F.col("location").alias("libelle")).alias("lieuTravail"), "description",
                        F.struct(F.col("url").alias("urlOrigine")).alias("origineOffre"), F.struct(pay.alias("libelle")).alias("salaire"))
        body = F.struct(F.array(item).alias("resultats"))
    return p.select("listing_id", F.to_json(body).alias("payload"))


_COLS = "title, company, location, description, url, salary_min, salary_max, contract_type, source, source_color"
_A = f"""SELECT listing_id, 0 AS pos, title, company, location, description, url, salary_min, salary_max, contract_type,
   'adzuna' AS source, '{COLOR['adzuna']}' AS source_color FROM listing
 UNION ALL SELECT listing_id, 1, title, '', '', '', '', NULL, NULL, NULL, 'adzuna', '{COLOR['adzuna']}' FROM listing"""
_B = f"""SELECT listing_id, 0 AS pos, title, company, location, description, url,
   CASE WHEN salary_max IS NOT NULL THEN CAST((40 + listing_id % 50) * 1000 + listing_id % 1000 AS DOUBLE) END AS salary_min,
   CAST(NULL AS DOUBLE) AS salary_max, CAST(NULL AS VARCHAR) AS contract_type, 'jooble' AS source, '{COLOR['jooble']}' AS source_color FROM listing"""
_C = f"""SELECT listing_id, 0 AS pos, title, CASE WHEN contract_type IS NULL THEN 'Non précisé' ELSE company END AS company, location,
   description, url, CAST(2000 + listing_id % 900 AS DOUBLE) + 0.5 AS salary_min, CAST(NULL AS DOUBLE) AS salary_max,
   CAST(NULL AS VARCHAR) AS contract_type, 'france_travail' AS source, '{COLOR['france_travail']}' AS source_color FROM listing"""


@query("s4_adzuna_payload", _A, uses=("listing",))
def _(t):
    return ls.adzuna_listings(_payloads(t, "adzuna"), keep=["listing_id"])


@query("s5_jooble_payload", _B, uses=("listing",))
def _(t):
    return ls.jooble_listings(_payloads(t, "jooble"), keep=["listing_id"])


@query("s6_france_travail_payload", _C, uses=("listing",))
def _(t):
    return ls.france_travail_listings(_payloads(t, "france_travail"), keep=["listing_id"])


_UNION = f"un AS ({_A} UNION ALL {_B} UNION ALL {_C})"


def _union(t):
    return ls.union_sources([ls.adzuna_listings(_payloads(t, "adzuna"), keep=["listing_id"]),
                             ls.jooble_listings(_payloads(t, "jooble"), keep=["listing_id"]),
                             ls.france_travail_listings(_payloads(t, "france_travail"), keep=["listing_id"])])


@query("u5_source_union", f"WITH {_UNION} SELECT listing_id, pos, {_COLS} FROM un", uses=("listing",))
def _(t):
    return _union(t)


@query("p18_active_sources", f"WITH {_UNION} SELECT listing_id, pos, source, title FROM un WHERE source IN ('adzuna', 'france_travail')",
       uses=("listing",))
def _(t):
    return ls.union_sources([_union(t)], active=["adzuna", "france_travail"]).select("listing_id", "pos", "source", "title")


@query("p19_source_salary_filter", """SELECT listing_id, source, salary_min, salary_max FROM listing WHERE source = 'jooble'
   AND (coalesce(salary_min, 0) <> 0 OR coalesce(salary_max, 0) <> 0)""", uses=("listing",))
def _(t):
    return ls.salary_only(t.listing.filter(F.col("source") == "jooble")).select("listing_id", "source", "salary_min", "salary_max")


_PG = """pg AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, 'adzuna' AS source, 1 AS so FROM pages
   UNION ALL SELECT page_id, regexp_replace(url, '[?#].*$', ''), 'jooble', 2 FROM pages)"""


def _pages(t):
    p = t.pages.select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("url"))
    return p.withColumn("source", F.lit("adzuna")).withColumn("so", F.lit(1)).unionByName(
        p.withColumn("source", F.lit("jooble")).withColumn("so", F.lit(2)))


@query("w11_first_seen_by_url", f"""WITH {_PG} SELECT url, page_id, source FROM (SELECT *, row_number() OVER
   (PARTITION BY url ORDER BY so, page_id) AS r FROM pg) WHERE r = 1""")
def _(t):
    return ls.first_seen(_pages(t), ["url"], ["so", "page_id"]).select("url", "page_id", "source")


@query("a14_duplicates_removed", f"""WITH {_PG} SELECT source, count(*) AS seen, count(DISTINCT url) AS kept,
   count(*) - count(DISTINCT url) AS duplicates_removed FROM pg GROUP BY source""")
def _(t):
    return ls.duplicates_removed(_pages(t), ["source"])


# --- salary, department, place ----------------------------------------------------------------
@query("e7_department_code", "SELECT listing_id, location, substr(location, 1, 2) AS department FROM listing", uses=("listing",))
def _(t):
    return t.listing.select("listing_id", "location", contact.department_code(F.col("location")).alias("department"))


@query("e7_department_of_free_text", r"""SELECT doc_id, CASE WHEN length(d) >= 5 THEN substr(d, 1, 2) WHEN length(d) IN (2, 3) THEN d END
   AS department FROM (SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS d FROM documents)""")
def _(t):
    return t.documents.select("doc_id", contact.department_code(F.col("text")).alias("department"))


_PAY = "CAST(CAST(floor(o_totalprice / 1000) AS INT) AS STRING) || ' ' || lpad(CAST(CAST(o_orderkey % 1000 AS INT) AS STRING), 3, '0')"


@query("e8_salary_thousands", """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE
    CAST(floor(o_totalprice / 1000) AS BIGINT) * 1000.0 + o_orderkey % 1000 END AS salary_min FROM orders""")
def _(t):
    body = F.concat_ws(" ", F.floor(F.col("o_totalprice") / 1000).cast("string"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"))
    text = F.when(F.col("o_orderpriority") == "1-URGENT", "Negotiable").otherwise(F.concat(F.lit("from "), body, F.lit(" EUR")))
    return t.orders.select("o_orderkey", contact.salary_min_thousands(text).alias("salary_min"))


@query("e9_salary_decimal", "SELECT o_orderkey, round(o_totalprice, 2) AS salary_min FROM orders")
def _(t):
    text = F.concat(F.lit("Mensuel de "), F.replace(F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(",")),
                    F.lit(" Euros à 9999.0 Euros"))
    return t.orders.select("o_orderkey", contact.salary_min_decimal(text).alias("salary_min"))


@query("p21_search_place", """SELECT doc_id, CASE WHEN lang = 'fr' THEN 'Hauts-de-France' WHEN lang = 'de' THEN NULL
    WHEN lang = 'es' THEN city ELSE postal || ' ' || city END AS place,
    CASE WHEN lang IN ('fr', 'de') THEN NULL ELSE 30 END AS distance FROM cv_flat""", uses=("cv_flat",))
def _(t):
    lang = F.col("lang")
    p = search.search_place(F.when(lang == "fr", "Hauts-de-France"), F.when(lang != "es", F.col("postal")),
                            F.when(lang != "de", F.col("city")))
    return t.cv_flat.select("doc_id", p.alias("p")).select("doc_id", "p.place", "p.distance")


# --- queries ----------------------------------------------------------------------------------
FLAT_SKILLS = [(7, "machine learning"), (13, "scikit-learn"), (2, "docker"), (11, "terraform"), (3, "aws"), (1, "python"), (4, "sql"),
               (5, "kafka"), (6, "spark"), (10, "power bi"), (8, "react"), (9, "git"), (12, "crm")]
SKILL_LIST = "[x.s FOR x IN [" + ", ".join(f"{{'r': {r}, 's': '{s}'}}" for r, s in FLAT_SKILLS) + "] IF x.r <= n_skill]"
JOB_TITLE = "coalesce(title, CASE WHEN n_exp >= 1 THEN e1_title END)"
EXP_TEXT = r"""lower(concat_ws(' ', CASE WHEN n_exp >= 1 THEN e1_title || ' ' || e1_company || ' ' || regexp_replace(replace(body, chr(10), ' '), '[ \t]+', ' ', 'g') END,
   CASE WHEN n_exp >= 2 THEN e2_title || ' ' || e2_company || ' ' || e2_bullet END, CASE WHEN n_exp >= 3 THEN e3_title || ' ' || e3_company END))"""
SECTOR_CASE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(ex, '{k}')" for k in ks) + f" THEN '{name}'" for name, ks in lx.SECTOR_WORDS) + " END"
QUERY_SQL = rf"""qb AS (SELECT doc_id, {JOB_TITLE} AS jt, {EXP_TEXT} AS ex, array_to_string(list_slice({SKILL_LIST}, 1, 3), ' ') AS sk,
     postal || ' ' || city AS place FROM cv_flat),
  qs AS (SELECT doc_id, jt, {SECTOR_CASE} AS sector, place, coalesce(replace(jt, 'Senior ', ''), sk) AS base FROM qb)"""
_SYN = sql_values([(i, c, s, j) for i, (c, ss) in enumerate(lx.TITLE_SYNONYMS) for j, s in enumerate([c, *ss])], "g, canonical, name, j")


@query("e18_base_query", f"WITH {QUERY_SQL} SELECT doc_id, base AS query FROM qs", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", search.base_query(F.col("job_title"), F.col("skills_flat")).alias("query"))


@query("j7_title_synonyms", f"""WITH ti AS (SELECT doc_id, e2_title AS title FROM cv_flat UNION ALL SELECT doc_id, e3_title FROM cv_flat),
   sy AS (SELECT * FROM {_SYN}), g AS (SELECT DISTINCT title, min(g) AS g FROM (SELECT DISTINCT title FROM ti), sy
     WHERE contains(lower(title), name) GROUP BY title),
   o AS (SELECT title, name, row_number() OVER (PARTITION BY title ORDER BY j) AS i FROM g JOIN sy USING (g) WHERE NOT contains(lower(title), name))
   SELECT ti.doc_id, ti.title, coalesce(string_agg(name, '|' ORDER BY i) FILTER (WHERE i <= 2), '') AS synonyms
   FROM ti LEFT JOIN o ON o.title = ti.title GROUP BY ti.doc_id, ti.title""", uses=("cv_flat",))
def _(t):
    flat = t.cv_flat
    ti = flat.select("doc_id", F.col("e2_title").alias("title")).unionByName(flat.select("doc_id", F.col("e3_title").alias("title")))
    return ti.select("doc_id", "title", F.array_join(search.synonym_queries(F.col("title")), "|").alias("synonyms"))


@query("j8_sector_words", f"WITH {QUERY_SQL} SELECT doc_id, sector FROM qs", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", records.sector_of(F.col("experience")).alias("sector"))


VARIANTS = """CASE WHEN base = '' THEN '' WHEN jt IS NOT NULL AND sector IS NOT NULL AND NOT contains(lower(base), sector)
   THEN base || '|' || base || ' ' || sector ELSE base END"""


@query("u6_query_variants", f"WITH {QUERY_SQL} SELECT doc_id, {VARIANTS} AS queries FROM qs", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", F.array_join(search.query_variants(F.col("job_title"), F.col("skills_flat"), F.col("sector")), "|").alias("queries"))


@query("p24_title_override", f"SELECT doc_id, CASE WHEN lang = 'en' THEN 'Data scientist' ELSE {JOB_TITLE} END AS job_title FROM cv_flat", uses=("cv_flat",))
def _(t):
    lang = t.documents.select("doc_id", F.when(F.col("lang") == "en", " Data scientist ").otherwise(" ").alias("wanted"))
    return t.cv.join(lang, "doc_id").select("doc_id", F.coalesce(F.nullif(F.trim("wanted"), F.lit("")), F.col("job_title")).alias("job_title"))


# --- scoring and ranking ----------------------------------------------------------------------
JD = rf"""jt0 AS (SELECT listing_id, lower(unnest(ws)) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT listing_id,
      regexp_extract_all({FOLD.format('description')}, '\b[a-zA-Z][a-zA-Z0-9+#.]+\b') AS ws FROM listing)),
   jc AS (SELECT listing_id, w, count(*) AS n, min(pos) AS p FROM jt0 WHERE length(w) > 2 AND w NOT IN ({STOPS}) GROUP BY ALL),
   jk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY n DESC, p) AS kr FROM jc) WHERE kr <= 40)"""
STRUCT = """least(1.0, CASE WHEN n_exp > 0 THEN 0.25 ELSE 0.0 END + CASE WHEN n_edu > 0 THEN 0.25 ELSE 0.0 END + CASE WHEN n_skill > 0 THEN 0.25 ELSE 0.0 END
   + CASE WHEN summary IS NOT NULL THEN 0.083 ELSE 0.0 END + CASE WHEN n_proj > 0 THEN 0.083 ELSE 0.0 END
   + CASE WHEN n_skill > 0 THEN least(n_skill / 10.0, 0.15) ELSE 0.0 END)"""
# Coordinates of the towns that records and listings name: what a caller would bring as a table.
TOWNS = [("croix", "59", 50.678, 3.149), ("lille", "59", 50.629, 3.057), ("lyon", "69", 45.758, 4.835), ("saint-etienne", "42", 45.439, 4.387),
         ("aix-en-provence", "13", 43.529, 5.447), ("nantes", "44", 47.218, -1.554), ("paris", "75", 48.857, 2.352)]
DIMS = 64  # of the hashed embedding in these queries
_KM = "2 * 6371.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"
_TOWN = "strip_accents(lower(trim(regexp_replace({0}, '[0-9]', '', 'g'))))"
_MARKED = r"regexp_replace({0}, '([\p{{L}}\p{{N}}_]+)', '|\1|', 'g')"  # bars at the ends of words
MATCH = rf"""{QUERY_SQL}, {JD},
   tw AS (SELECT * FROM {sql_values(TOWNS, "town, department, lat, lon")}),
   nr AS (SELECT a.town, b.town AS other FROM tw a, tw b WHERE {_KM} <= 30),
   sv AS (SELECT doc_id, {_TOWN.format("place")} AS town, string_split({VARIANTS}, '|') AS qv FROM qs WHERE base <> ''),
   sr AS (SELECT doc_id, town, greatest(5, CAST(floor(20 / len(qv)) AS INT)) AS page, lower(unnest(qv)) AS query, generate_subscripts(qv, 1) - 1 AS qo FROM sv),
   qd AS (SELECT query, {_MARKED.format("query")} AS phrase FROM (SELECT DISTINCT query FROM sr)),
   tx AS (SELECT listing_id, source, {_TOWN.format("location")} AS spot, 0 AS part, {_MARKED.format("lower(title)")} AS body FROM listing
      UNION ALL SELECT listing_id, source, {_TOWN.format("location")}, 1, {_MARKED.format("lower(description)")} FROM listing),
   pt AS (SELECT query, listing_id, source, spot, min(part) AS part FROM qd JOIN tx ON contains(body, phrase) GROUP BY ALL),
   an AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query, town, source ORDER BY part, listing_id) AS r,
      CASE source WHEN 'adzuna' THEN 1 WHEN 'jooble' THEN 2 ELSE 3 END AS sx FROM (SELECT pt.*, nr.town FROM pt JOIN nr ON nr.other = pt.spot)) WHERE r <= 20),
   sh AS (SELECT sr.doc_id, an.listing_id, an.source, l.url, sr.qo, an.sx, an.r FROM sr JOIN an ON an.query = sr.query AND an.town = sr.town
      AND an.r <= sr.page JOIN listing l ON l.listing_id = an.listing_id),
   fs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, url ORDER BY qo, sx, r) AS u, count(*) OVER (PARTITION BY doc_id, url) AS shown FROM sh) WHERE u = 1),
   cr AS (SELECT doc_id, text AS raw FROM cv_text),
   dx AS (SELECT raw AS txt FROM cr WHERE doc_id IN (SELECT doc_id FROM fs) UNION SELECT description FROM listing WHERE listing_id IN (SELECT listing_id FROM fs)),
   {vectors_sql("dx", DIMS, 256)},
   pk AS MATERIALIZED (SELECT doc_id, listing_id, md5(raw) AS x, md5(description) AS y FROM fs JOIN cr USING (doc_id) JOIN listing USING (listing_id)),
   sm AS (SELECT doc_id, listing_id, list_inner_product(a.vec, b.vec) AS sim FROM pk JOIN hv a ON a.tid = x JOIN hv b ON b.tid = y),
   sc AS (SELECT fs.doc_id, fs.listing_id, fs.source, fs.qo, fs.sx, fs.r, fs.shown, {STRUCT} AS structure, least(1.0, coalesce(sim, 0.0)) AS semantic,
      coalesce((SELECT avg(CASE WHEN contains(lower(c.text), jk.w) THEN 1.0 ELSE 0.0 END) FROM jk WHERE jk.listing_id = fs.listing_id), 0.5) AS keyword
      FROM fs JOIN cv_text c ON c.doc_id = fs.doc_id LEFT JOIN sm ON sm.doc_id = fs.doc_id AND sm.listing_id = fs.listing_id),
   so AS (SELECT *, round(semantic * 35 + keyword * 40 + structure * 25, 1) AS overall FROM sc),
   ra AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY overall DESC, qo, sx, r) AS rank,
      max(CASE WHEN overall >= 25 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS passed FROM so),
   fm AS (SELECT * FROM ra WHERE overall >= 25 OR passed = 0)"""


def _embed(rows, text, out):
    return hashed_embedding(rows, text, out, DIMS)


def _places(t):
    return t.spark.createDataFrame([(name, *rest) for name, *rest in TOWNS], "name string, department string, lat double, lon double").withColumn("id", F.col("name"))


def _matches(t):
    return mt.find_matching_jobs(t.cv, t.listing, embed=_embed, places=_places(t))


def _scored(t):
    return mt.scored_candidates(t.cv, t.listing, embed=_embed, places=_places(t))


@query("m4_find_matching_jobs", f"""WITH {MATCH} SELECT doc_id, listing_id, source, round(semantic, 5) AS semantic, round(keyword, 6) AS keyword,
   round(structure, 6) AS structure, overall, rank FROM fm""", uses=("cv_text", "listing"))
def _(t):
    return _matches(t).select(
        "doc_id", "listing_id", "source", F.round("semantic", 5).alias("semantic"), F.round("keyword", 6).alias("keyword"), F.round("structure", 6).alias("structure"), "overall", "rank")


@query("j5_scored_pairs", f"WITH {MATCH} SELECT doc_id, listing_id, overall FROM so", uses=("cv_text", "listing"))
def _(t):
    return _scored(t).select("doc_id", "listing_id", "overall")


@query("w10_rank_listings", f"WITH {MATCH} SELECT doc_id, listing_id, rank FROM ra", uses=("cv_text", "listing"))
def _(t):
    return mt.rank_matches(_scored(t), min_score=-1.0).select("doc_id", "listing_id", "rank")


@query("p20_min_score_fallback", f"WITH {MATCH} SELECT doc_id, listing_id, overall FROM fm", uses=("cv_text", "listing"))
def _(t):
    return _matches(t).select("doc_id", "listing_id", "overall")


@query("t7_top_matches", f"WITH {MATCH} SELECT doc_id, listing_id, rank, overall FROM fm WHERE rank <= 10", uses=("cv_text", "listing"))
def _(t):
    return mt.top_matches(_matches(t)).select("doc_id", "listing_id", "rank", "overall")


@query("a14_match_summary", f"""WITH {MATCH}, a AS (SELECT doc_id, CAST(sum(shown) - count(*) AS BIGINT) AS duplicates_removed,
     count(*) FILTER (WHERE overall >= 25) < 3 AS few_results FROM so GROUP BY doc_id),
   b AS (SELECT doc_id, count(*) AS matches, count(*) FILTER (WHERE source = 'adzuna') AS n_adzuna, count(*) FILTER (WHERE source = 'jooble') AS n_jooble FROM fm GROUP BY doc_id)
   SELECT doc_id, duplicates_removed, few_results, matches, n_adzuna, n_jooble FROM a JOIN b USING (doc_id)""", uses=("cv_text", "listing"))
def _(t):
    m = F.col("source_counts")
    return mt.match_report(t.cv, t.listing, embed=_embed, places=_places(t))[2].select("doc_id", "duplicates_removed", "few_results", "matches",
        F.coalesce(F.try_element_at(m, F.lit("adzuna")), F.lit(0)).alias("n_adzuna"), F.coalesce(F.try_element_at(m, F.lit("jooble")), F.lit(0)).alias("n_jooble"))


@query("e34_job_card", """SELECT listing_id, CASE WHEN coalesce(salary_min, 0) <> 0 OR coalesce(salary_max, 0) <> 0 THEN
     CASE WHEN coalesce(salary_min, 0) <> 0 THEN replace(format('{:,}', CAST(floor(salary_min) AS BIGINT)), ',', ' ') ELSE '?' END || ' – ' ||
     CASE WHEN coalesce(salary_max, 0) <> 0 THEN replace(format('{:,}', CAST(floor(salary_max) AS BIGINT)), ',', ' ') ELSE '?' END END AS pay,
   concat_ws(' · ', nullif(company, ''), nullif(location, ''), contract_type) AS meta FROM listing""", uses=("listing",))
def _(t):
    from sparkfolio.operators.report import card_meta, pay_range
    return t.listing.select("listing_id", pay_range(F.col("salary_min"), F.col("salary_max")).alias("pay"),
                            card_meta(F.col("company"), F.col("location"), F.col("contract_type")).alias("meta"))

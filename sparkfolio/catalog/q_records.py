"""Record parsing, dates, timelines, criteria and report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.catalog.derived import AS_OF, pick
from sparkfolio.catalog.q_matching import JOB_TITLE, SKILL_LIST, STRUCT
from sparkfolio.catalog.registry import query
from sparkfolio.functions import contact, dates
from sparkfolio.functions import text as tx
from sparkfolio.operators import cascade, records as rec, report as rp, timeline as tl
from sparkfolio.operators import keywords as kw

CV = ("cv_text",)
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
WC = rf"len(regexp_extract_all({CLEAN}, '\S+'))"
NOW = AS_OF[0] * 12 + AS_OF[1]


def parsed(t, *fields):
    return rec.parse_text(t.cv_text.select("doc_id", "text"), as_of=AS_OF, fields=fields)


def lines_of(t):
    return t.cv_text.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_LINES = """ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM cv_text),
  st AS (SELECT *, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS s FROM ln)"""
_TITLES = "|".join(lx.TITLE_WORDS)
# Title words start and end with a letter; doubling separators lets guards stand in for \b.
_HAS_TITLE = rf"regexp_matches(lower({{0}}), '(^|[^\p{{{{L}}}}\p{{{{N}}}}_])({_TITLES})($|[^\p{{{{L}}}}\p{{{{N}}}}_])')"


def has_title_sql(c):
    return _HAS_TITLE.replace("{{", "{").replace("}}", "}").replace("{0}", c)


_UP = "(upper(s) = s AND lower(s) <> s)"
_SECTION = "CASE " + " ".join(
    "WHEN regexp_matches(k, '(?i)" + p.replace("'", "''") + f"') THEN '{n}'" for n, p in lx.SECTION_PATTERNS.items()) + " END"


# --- line predicates --------------------------------------------------------------------------
@query("p5_header_positioned", f"""WITH {_LINES}, sz AS (SELECT *, CASE WHEN line_no % 5 = 0 THEN 14.0 ELSE 10.0 END AS size, line_no % 3 = 0 AS bold FROM st)
  SELECT doc_id, line_no, s <> '' AND length(s) <= 80 AND (size > 10.0 * 1.08 OR (bold AND size >= 9.5) OR {_UP} OR suffix(s, ':')
    OR regexp_matches(s, '^[A-ZÀ-Ý][A-Za-zÀ-ÿ\\s&/éèêàûùâôî]+$')) AS is_header FROM sz""", uses=CV)
def _(t):
    n = F.col("line_no")
    return lines_of(t).select("doc_id", "line_no", tx.is_header_line(
        F.col("line"), F.when(n % 5 == 0, 14.0).otherwise(10.0), n % 3 == 0, F.lit(10.0)).alias("is_header"))


@query("p6_header_text", f"""WITH {_LINES} SELECT doc_id, line_no, s <> '' AND length(s) <= 60 AND ({_UP} OR suffix(s, ':')
    OR regexp_matches(s, '^[A-Z][A-Za-z\\s&/]+$')) AS is_header FROM st""", uses=CV)
def _(t):
    return lines_of(t).select("doc_id", "line_no", tx.is_header_text(F.col("line")).alias("is_header"))


@query("p7_bullet", f"""WITH {_LINES} SELECT doc_id, line_no, regexp_matches(line, '^\\s*[•–\\-—▪◦◆▸→★*·]\\s*') OR
   (prefix(line, '-') AND length(line) > 2) AS bullet FROM st""", uses=CV)
def _(t):
    return lines_of(t).select("doc_id", "line_no", tx.is_bullet(F.col("line")).alias("bullet"))


@query("p8_contains_date", f"""WITH {_LINES} SELECT doc_id, line_no, regexp_matches(line, '\\b(19|20)\\d{{2}}\\b') AS dated FROM st""", uses=CV)
def _(t):
    return lines_of(t).select("doc_id", "line_no", dates.contains_date(F.col("line")).alias("dated"))


@query("p9_person_name", f"""WITH {_LINES}, w AS (SELECT *, regexp_extract_all(s, '\\S+') AS ws FROM st) SELECT doc_id, line_no,
   len(ws) BETWEEN 2 AND 4 AND len(list_filter(ws, lambda x: NOT regexp_matches(x, '^[A-Z][A-Za-zà-öù-ÿ''-]+$'))) = 0 AND NOT {has_title_sql('s')} AS person FROM w""", uses=CV)
def _(t):
    return lines_of(t).select("doc_id", "line_no", tx.is_person_name(tx.strip(F.col("line"))).alias("person"))


_STREETS = ", ".join(f"'{w}'" for w in lx.STREET_WORDS)
_ADDR = ", ".join(["'rue'", "'Avenue'", "'Port'", "'lieu-dit'", "'Jaurès'"])


@query("p10_street_word", f"""SELECT o_orderkey, len(list_intersect(string_split_regex(lower(a), '[\\s\\-]+'), [{_STREETS}])) > 0 AS street FROM
   (SELECT o_orderkey, CAST(o_orderkey AS STRING) || ' ' || {pick('rue,Avenue,Port,lieu-dit,Jaurès', 'o_orderkey')} || ' ' || o_orderpriority AS a FROM orders)""")
def _(t):
    from pyspark.sql.functions import expr
    a = F.concat_ws(" ", F.col("o_orderkey").cast("string"), expr(pick("rue,Avenue,Port,lieu-dit,Jaurès", "o_orderkey")), "o_orderpriority")
    return t.orders.select("o_orderkey", tx.has_street_word(a).alias("street"))


@query("p11_metric_present", rf"SELECT doc_id, " + " OR ".join(
    f"regexp_matches(text, '{p}')" for p in lx.METRIC_PATTERNS) + " AS has_metric FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.has_metric(F.col("text")).alias("has_metric"))


@query("e29_section_name", f"""WITH {_LINES}, n AS (SELECT *, regexp_replace(regexp_replace(lower(line), ':+$', ''), '^\\s+|\\s+$', '', 'g') AS k FROM st)
   SELECT doc_id, line_no, {_SECTION} AS section FROM n""", uses=CV)
def _(t):
    return lines_of(t).select("doc_id", "line_no", tx.section_name(F.col("line")).alias("section"))


@query("w3_section_carry", f"""WITH {_LINES}, n AS (SELECT *, regexp_replace(regexp_replace(lower(line), ':+$', ''), '^\\s+|\\s+$', '', 'g') AS k FROM st),
   m AS (SELECT *, CASE WHEN s <> '' AND length(s) <= 60 AND ({_UP} OR suffix(s, ':') OR regexp_matches(s, '^[A-Z][A-Za-z\\s&/]+$')) THEN {_SECTION} END AS mark FROM n)
   SELECT doc_id, line_no, section FROM (SELECT doc_id, line_no, mark, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), 'header') AS section FROM m)
   WHERE mark IS NULL""", uses=CV)
def _(t):
    from sparkfolio.operators.layout import carry_sections
    return carry_sections(lines_of(t), "doc_id", "line_no", F.when(tx.is_header_text(F.col("line")), tx.section_name(F.col("line")))).select(
        "doc_id", "line_no", "section")


# --- parsing gives back what was rendered -----------------------------------------------------
@query("e4_postal_city", "SELECT doc_id, city, postal FROM cv_flat", uses=("cv_flat",))
def _(t):
    return t.cv_text.select("doc_id", contact.city(F.col("text")).alias("city"), contact.postal_code(F.col("text")).alias("postal"))


@query("t10_header_record", "SELECT doc_id, name, title, email, phone, city, postal, github, linkedin FROM cv_flat", uses=("cv_flat",))
def _(t):
    h = F.col("header")
    return parsed(t, "header").select("doc_id", h["name"].alias("name"), h["title"].alias("title"), h["email"].alias("email"), h["phone"].alias("phone"),
                            h["location"].alias("city"), h["postal_code"].alias("postal"), h["github"].alias("github"), h["linkedin"].alias("linkedin"))


_M2 = lambda y, m: f"CAST({y} AS STRING) || '-' || lpad(CAST({m} AS STRING), 2, '0')"
EXPS = f"""SELECT doc_id, 1 AS i, e1_title AS title, e1_company AS company, {_M2('e1_sy', 'e1_sm')} AS date_start, 'present' AS date_end,
     {NOW} - e1_sy * 12 - e1_sm AS months, true AS is_current FROM cv_flat WHERE n_exp >= 1
  UNION ALL SELECT doc_id, 2, e2_title, e2_company, {_M2('e2_sy', 'e2_sm')}, {_M2('e2_ey', 'e2_em')}, (e2_ey - e2_sy) * 12 + e2_em - e2_sm, false FROM cv_flat WHERE n_exp >= 2
  UNION ALL SELECT doc_id, 3, e3_title, e3_company, CAST(e3_sy AS STRING), CAST(e3_ey AS STRING), (e3_ey - e3_sy) * 12, false FROM cv_flat WHERE n_exp >= 3"""
EDUS = """SELECT doc_id, 1 AS i, d1_degree AS degree, d1_school AS school, d1_sy AS sy, d1_ey AS ey FROM cv_flat WHERE n_edu >= 1
  UNION ALL SELECT doc_id, 2, '', d2_school, d2_sy, d2_ey FROM cv_flat WHERE n_edu >= 2"""


@query("e24_experience_entries", EXPS, uses=("cv_flat",))
def _(t):
    return parsed(t, "experience").select("doc_id", F.posexplode("experience").alias("i", "e")).select(
        "doc_id", (F.col("i") + 1).alias("i"), "e.title", "e.company", "e.date_start", "e.date_end",
        F.col("e.duration_months").alias("months"), "e.is_current")


_BODY_LINES = r"list_transform(string_split(regexp_replace(body, '[ \t]+', ' ', 'g'), chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g'))"


@query("w7_entry_segmentation", rf"""WITH b AS (SELECT *, {_BODY_LINES} AS bl FROM cv_flat)
   SELECT doc_id, 1 AS entry, 2 + len(bl) AS lines FROM b WHERE n_exp >= 1
   UNION ALL SELECT doc_id, 2, 3 FROM b WHERE n_exp >= 2 UNION ALL SELECT doc_id, 3, 2 FROM b WHERE n_exp >= 3""", uses=("cv_flat",))
def _(t):
    chunks = rec.section_chunks(rec.text_lines(F.col("text")), F.lit(12.0))
    groups = rec.entry_groups(rec.section_lines(chunks, "experience"))
    return t.cv_text.select("doc_id", F.posexplode(groups).alias("i", "g")).select(
        "doc_id", (F.col("i") + 1).alias("entry"), F.size("g").alias("lines"))


@query("e24_experience_bullets", rf"""WITH b AS (SELECT doc_id, n_exp, e2_bullet, {_BODY_LINES} AS bl FROM cv_flat)
   SELECT doc_id, 1 AS i, unnest(bl) AS bullet, generate_subscripts(bl, 1) AS k FROM b WHERE n_exp >= 1
   UNION ALL SELECT doc_id, 2, e2_bullet, 1 FROM b WHERE n_exp >= 2""", uses=("cv_flat",))
def _(t):
    e = parsed(t, "experience").select("doc_id", F.posexplode("experience").alias("i", "e"))
    return e.select("doc_id", (F.col("i") + 1).alias("i"), F.posexplode("e.bullets").alias("k", "bullet")).select(
        "doc_id", "i", "bullet", (F.col("k") + 1).alias("k"))


@query("p15_education_entries", EDUS, uses=("cv_flat",))
def _(t):
    return parsed(t, "education").select("doc_id", F.posexplode("education").alias("i", "e")).select(
        "doc_id", (F.col("i") + 1).alias("i"), "e.degree", "e.school", F.col("e.date_start").cast("int").alias("sy"), F.col("e.date_end").cast("int").alias("ey"))


_DEG = "CASE n_chars % 4 WHEN 0 THEN 'Cloud :' WHEN 1 THEN e2_title WHEN 2 THEN '' ELSE d2_school END"
_SCH = "CASE WHEN doc_id % 2 = 0 THEN '' ELSE d1_school END"


@query("p15_education_rejection", f"""SELECT doc_id, undated AND (suffix(degree, ':') OR (degree = '' AND school = '') OR ({has_title_sql('degree')} AND bare)) AS rejected
   FROM (SELECT doc_id, {_DEG} AS degree, {_SCH} AS school, n_chars % 3 <> 0 AS undated, doc_id % 3 = 0 AS bare FROM cv_flat)""", uses=("cv_flat",))
def _(t):
    return t.cv_flat.select("doc_id", rec.education_rejected(F.expr(_DEG), F.expr(_SCH), F.expr("n_chars % 3 <> 0"), F.expr("doc_id % 3 = 0")).alias("rejected"))


@query("p16_noise_entries", """SELECT doc_id, n_exp AS kept FROM cv_flat""", uses=("cv_flat",))
def _(t):
    noisy = F.regexp_replace("text", "(^|\n)PROFESSIONAL EXPERIENCE\n", "$1PROFESSIONAL EXPERIENCE\nPEN\n")
    src = t.cv_text.select("doc_id", F.when(F.col("n_exp") >= 1, noisy).otherwise(F.concat("text", F.lit("\nPROFESSIONAL EXPERIENCE\nPEN"))).alias("text"))
    return rec.parse_text(src, as_of=AS_OF, fields=["experience"]).select("doc_id", F.size("experience").alias("kept"))


@query("e25_project_entries", """SELECT doc_id, 1 AS i, p1_name AS name, p1_desc AS description, p1_url AS url, p1_metric AS metric,
     'docker,' || split_part('python,scala,rust,java', ',', CAST(1 + doc_id % 4 AS INT)) AS stack FROM cv_flat WHERE n_proj >= 1
   UNION ALL SELECT doc_id, 2, p2_name, p2_desc, NULL, '', 'php' FROM cv_flat WHERE n_proj >= 2""", uses=("cv_flat",))
def _(t):
    return parsed(t, "projects").select("doc_id", F.posexplode("projects").alias("i", "p")).select(
        "doc_id", (F.col("i") + 1).alias("i"), "p.name", "p.description", "p.url", F.array_join("p.metrics", "|").alias("metric"),
        F.array_join("p.stack", ",").alias("stack"))


@query("w8_blank_chunks", """SELECT doc_id, 1 AS chunk, p1_name AS first_line, 4 AS lines FROM cv_flat WHERE n_proj >= 1
   UNION ALL SELECT doc_id, 2, p2_name, 2 FROM cv_flat WHERE n_proj >= 2""", uses=("cv_flat",))
def _(t):
    chunks = rec.section_chunks(rec.text_lines(F.col("text")), F.lit(12.0))
    blocks = rec.blank_chunks(F.transform(rec.section_lines(chunks, "projects"), lambda x: x["text"]))
    return t.cv_text.select("doc_id", F.posexplode(blocks).alias("i", "b")).select(
        "doc_id", (F.col("i") + 1).alias("chunk"), F.get("b", F.lit(0)).alias("first_line"), F.size("b").alias("lines"))


@query("p17_language_list", "SELECT doc_id, CASE n_lang WHEN 0 THEN '' WHEN 1 THEN 'Français' ELSE 'Français,Anglais' END AS languages FROM cv_flat", uses=("cv_flat",))
def _(t):
    return parsed(t, "languages").select("doc_id", F.array_join("languages", ",").alias("languages"))


@query("p14_summary", "SELECT doc_id, summary FROM cv_flat", uses=("cv_flat",))
def _(t):
    return parsed(t, "summary").select("doc_id", "summary")


@query("p14_summary_from_header", "SELECT doc_id, summary FROM cv_flat", uses=("cv_flat",))
def _(t):
    src = t.cv_text.select("doc_id", F.regexp_replace("text", "\nSUMMARY\n", "\n").alias("text"))
    return rec.parse_text(src, as_of=AS_OF, fields=["summary"]).select("doc_id", "summary")


_HEADS = "CASE trim(line) WHEN 'SUMMARY' THEN 'summary' WHEN 'PROFESSIONAL EXPERIENCE' THEN 'experience' WHEN 'EDUCATION' THEN 'education' WHEN 'SKILLS' THEN 'skills' WHEN 'PROJECTS' THEN 'projects' WHEN 'LANGUAGES' THEN 'languages' END"


@query("w3_text_sections", rf"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM cv_text)),
   m AS (SELECT *, {_HEADS} AS h FROM l), s AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i) AS sec FROM m),
   g AS (SELECT doc_id, coalesce(sec, 'header') AS section, regexp_replace(string_agg(regexp_replace(line, '^[ \t\r\f\v]+|[ \t\r\f\v]+$', '', 'g'), chr(10) ORDER BY i), '^\s+|\s+$', '', 'g') AS text FROM s WHERE h IS NULL GROUP BY ALL)
   SELECT * FROM g WHERE text <> ''""", uses=("cv_text",))
def _(t):
    return t.cv_text.select("doc_id", F.explode(rec.text_sections(F.col("text"))).alias("section", "text"))


# --- dates ------------------------------------------------------------------------------------
_Y, _MO = "CAST(year(o_orderdate) AS INT)", "CAST(month(o_orderdate) AS INT)"
_EN, _FR = "Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec", "janvier,février,mars,avril,mai,juin,juillet,août,septembre,octobre,novembre,décembre"
_DATED = f"""SELECT o_orderkey, {_Y} AS y, {_MO} AS m, o_orderpriority AS p, CASE o_orderpriority
   WHEN '1-URGENT' THEN CAST({_Y} AS STRING) || ' - ' || CAST({_Y} + 3 AS STRING)
   WHEN '2-HIGH' THEN split_part('{_EN}', ',', {_MO}) || ' ' || CAST({_Y} AS STRING) || ' – ' || split_part('{_FR}', ',', {_MO}) || ' ' || CAST({_Y} + 1 AS STRING)
   WHEN '3-MEDIUM' THEN split_part('{_EN}', ',', {_MO}) || ' ' || CAST({_Y} AS STRING) || ' – en cours'
   WHEN '4-NOT SPECIFIED' THEN 'Stage de ' || CAST({_MO} AS STRING) || ' mois' ELSE 'Promotion ' || CAST({_Y} AS STRING) END AS line FROM orders"""


@query("e11_date_range", f"""WITH x AS ({_DATED}) SELECT o_orderkey, CASE p WHEN '4-NOT SPECIFIED' THEN NULL WHEN '2-HIGH' THEN {_M2('y', 'm')} WHEN '3-MEDIUM' THEN {_M2('y', 'm')} ELSE CAST(y AS STRING) END AS date_start,
   CASE p WHEN '1-URGENT' THEN CAST(y + 3 AS STRING) WHEN '2-HIGH' THEN {_M2('y + 1', 'm')} WHEN '3-MEDIUM' THEN 'present' END AS date_end,
   CASE p WHEN '1-URGENT' THEN 36 WHEN '2-HIGH' THEN 12 WHEN '3-MEDIUM' THEN {NOW} - y * 12 - m WHEN '4-NOT SPECIFIED' THEN m END AS months, p = '3-MEDIUM' AS is_current FROM x""")
def _(t):
    lines = t.spark.sql(_DATED.replace("FROM orders", "FROM {orders}"), orders=t.orders)
    return lines.select("o_orderkey", dates.date_range(F.col("line"), AS_OF).alias("r")).select("o_orderkey", "r.*")


@query("e12_month_year", f"SELECT o_orderkey, {_Y} AS y, CASE WHEN o_orderstatus = 'O' THEN 0 ELSE {_MO} END AS m FROM orders")
def _(t):
    text = F.expr(f"CASE o_orderstatus WHEN 'O' THEN CAST({_Y} AS STRING) WHEN 'F' THEN split_part('{_FR}', ',', {_MO}) || ' ' || CAST({_Y} AS STRING) "
                  f"ELSE split_part('{_EN}', ',', {_MO}) || ' ' || CAST({_Y} AS STRING) END")
    return t.orders.select("o_orderkey", dates.month_year(text).alias("d")).select("o_orderkey", "d.*")


@query("e13_months_between", f"""SELECT o_orderkey, greatest(0, (2000 - {_Y}) * 12 + 6 - {_MO}) AS months, {_M2(_Y, _MO)} AS text FROM orders""")
def _(t):
    s = F.struct(F.expr(_Y).alias("y"), F.expr(_MO).alias("m"))
    return t.orders.select("o_orderkey", dates.months_between(s, F.struct(F.lit(2000).alias("y"), F.lit(6).alias("m"))).alias("months"),
                           dates.date_text(s).alias("text"))


@query("e14_year_month", f"""SELECT o_orderkey, CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN NULL ELSE {_Y} END AS y,
   CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN {_MO} WHEN '3-MEDIUM' THEN {_MO} END AS m FROM orders""")
def _(t):
    text = F.expr(f"CASE o_orderpriority WHEN '1-URGENT' THEN CAST({_Y} AS STRING) WHEN '2-HIGH' THEN CAST({_Y} AS STRING) || '-' || lpad(CAST({_MO} AS STRING), 2, '0') "
                  f"WHEN '3-MEDIUM' THEN lpad(CAST({_MO} AS STRING), 2, '0') || '/' || CAST({_Y} AS STRING) WHEN '4-NOT SPECIFIED' THEN 'present' ELSE 'n/a' END")
    return t.orders.select("o_orderkey", dates.year_month(text).alias("d")).select("o_orderkey", "d.y", "d.m")


@query("e10_years_from_spans", f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 5.0 + (2026 - {_Y}) ELSE 5.0 END AS years FROM orders""")
def _(t):
    y = F.expr(_Y)
    text = F.concat(F.lit("Poste 1990 - 1993, puis "), y.cast("string"), F.lit(" – "), F.when(F.col("o_orderstatus") == "P", "présent").otherwise((y - 5).cast("string")),
                    F.lit(" et 1985—1987"))
    return t.orders.select("o_orderkey", dates.years_from_spans(text, 2026).alias("years"))


# --- timelines --------------------------------------------------------------------------------
@query("w1_gaps_between_orders", f"""WITH x AS (SELECT o_custkey, {_Y} * 12 + {_MO} AS s, {_Y} * 12 + {_MO} + CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 3 ELSE -9 END AS e, o_orderkey FROM orders),
   n AS (SELECT *, lead(s) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS nx FROM x)
   SELECT o_custkey, e AS gap_start, nx AS gap_end FROM n WHERE nx - e > 8""")
def _(t):
    s = F.expr(f"{_Y} * 12 + {_MO}")
    x = t.orders.select("o_custkey", s.alias("s"), (s + F.expr("CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 3 ELSE -9 END")).alias("e"), "o_orderkey")
    return tl.gaps_by_key(x, "o_custkey", "s", "e", "o_orderkey", 8)


_IV = f"""iv AS (SELECT doc_id, i, CASE WHEN length(date_start) = 4 THEN CAST(date_start AS INT) * 12 + 1 ELSE CAST(substr(date_start, 1, 4) AS INT) * 12 + CAST(substr(date_start, 6) AS INT) END AS s,
     CASE WHEN date_end = 'present' THEN {NOW} WHEN length(date_end) = 4 THEN CAST(date_end AS INT) * 12 + 1 ELSE CAST(substr(date_end, 1, 4) AS INT) * 12 + CAST(substr(date_end, 6) AS INT) END AS e FROM ({EXPS})
   UNION ALL SELECT doc_id, 10 + i, sy * 12 + 1, ey * 12 + 1 FROM ({EDUS}))"""


@query("w1_career_gaps", f"""WITH {_IV}, n AS (SELECT *, lead(s) OVER (PARTITION BY doc_id ORDER BY s, i) AS nx FROM iv)
   SELECT doc_id, CAST(e // 12 AS STRING) || '–' || CAST(nx // 12 AS STRING) || ' : ' || CAST(CAST(round_even(round((nx - e) / 12, 1), 0) AS INT) AS STRING) || ' an(s) sans activité détectée' AS gap
   FROM n WHERE nx - e > 12""", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", F.explode(tl.career_gaps(F.col("experience"), F.col("education"), AS_OF)).alias("gap"))


@query("w1_career_gaps_merged", f"""WITH {_IV}, n AS (SELECT doc_id, max(e) OVER (PARTITION BY doc_id ORDER BY s, i) AS e, lead(s) OVER (PARTITION BY doc_id ORDER BY s, i) AS nx FROM iv)
   SELECT doc_id, CAST(e // 12 AS STRING) || '–' || CAST(nx // 12 AS STRING) || ' : ' || CAST(CAST(round_even(round((nx - e) / 12, 1), 0) AS INT) AS STRING) || ' an(s) sans activité détectée' AS gap
   FROM n WHERE nx - e > 12""", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", F.explode(tl.career_gaps(F.col("experience"), F.col("education"), AS_OF, merged=True)).alias("gap"))


@query("a10_career_stats", f"""WITH x AS (SELECT doc_id, sum(months) AS mo, min(CAST(substr(date_start, 1, 4) AS INT)) AS sy FROM ({EXPS}) GROUP BY doc_id),
   d AS (SELECT doc_id, sum((ey - sy) * 12) AS em FROM ({EDUS}) GROUP BY doc_id)
   SELECT c.doc_id, round(coalesce(mo, 0) / 12, 1) AS total_experience_years, x.sy AS career_start_year, CASE WHEN n_exp >= 1 THEN e1_title || ' @ ' || e1_company END AS most_recent_role,
     CAST(round_even(coalesce(em, 0) / 12, 0) AS INT) AS education_years FROM cv_flat c LEFT JOIN x ON x.doc_id = c.doc_id LEFT JOIN d ON d.doc_id = c.doc_id""", uses=("cv_flat",))
def _(t):
    return tl.career_stats(t.cv)


@query("a11_experience_years", f"""SELECT c.doc_id, round(mo / 12, 1) AS years FROM cv_flat c LEFT JOIN (SELECT doc_id, sum(months) AS mo FROM ({EXPS}) GROUP BY doc_id) x ON x.doc_id = c.doc_id""", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", F.col("experience_years").alias("years"))


@query("p13_sufficient_dates", "SELECT doc_id, n_exp >= 1 AS has_dates FROM cv_flat", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", rp.has_dates().alias("has_dates"))


@query("t4_experience_order", f"SELECT doc_id, i, title FROM ({EXPS})", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", F.posexplode(rec.by_recency(F.reverse("experience"))).alias("i", "e")).select("doc_id", (F.col("i") + 1).alias("i"), "e.title")


@query("t5_timeline_order", f"""WITH ev AS (SELECT doc_id, 'experience' AS kind, title || ' @ ' || company AS label, CAST(substr(date_start, 1, 4) AS INT) AS y,
     CASE WHEN length(date_start) > 4 THEN CAST(substr(date_start, 6) AS INT) ELSE 1 END AS m, i FROM ({EXPS})
   UNION ALL SELECT doc_id, 'education', CASE WHEN degree = '' THEN school ELSE degree || ' — ' || school END, sy, 1, 10 + i FROM ({EDUS}))
   SELECT doc_id, kind, label, y, row_number() OVER (PARTITION BY doc_id ORDER BY y DESC, m DESC, i) AS pos FROM ev""", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", F.posexplode(tl.timeline(F.col("experience"), F.col("education"))).alias("i", "e")).select(
        "doc_id", "e.kind", "e.label", "e.y", (F.col("i") + 1).alias("pos"))


# --- record scores ----------------------------------------------------------------------------
@query("a5_structure_score", f"SELECT doc_id, round({STRUCT}, 6) AS structure FROM cv_flat", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", F.round(kw.structure_score(F.col("sections"), F.col("skills_flat")), 6).alias("structure"))


@query("a13_richness", """SELECT doc_id, CAST(n_exp * 10 + n_edu * 8 + (n_skill - CASE WHEN n_skill >= 12 THEN 1 ELSE 0 END) * 2 + n_proj * 10 + CASE WHEN email IS NULL THEN 0 ELSE 15 END
   + CASE WHEN title IS NULL THEN 0 ELSE 15 END + CASE WHEN summary IS NULL THEN 0 ELSE 10 END AS DOUBLE) AS richness FROM cv_flat""", uses=("cv_flat",))
def _(t):
    c = F.col
    return t.cv.select("doc_id", rec.richness(c("header"), c("summary"), c("skills"), c("experience"), c("education"), c("projects")).alias("richness"))


@query("a25_missing_sections", """SELECT doc_id, concat_ws(',', CASE WHEN n_exp = 0 THEN 'experience' END, CASE WHEN n_edu = 0 THEN 'education' END, CASE WHEN n_skill = 0 THEN 'skills' END) AS missing FROM cv_flat""", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", F.array_join(rp.missing_sections(), ",").alias("missing"))


@query("u4_section_difference", """SELECT doc_id, concat_ws(',', CASE WHEN summary IS NOT NULL THEN 'summary' END, CASE WHEN n_exp > 0 THEN 'experience' END, CASE WHEN n_edu > 0 THEN 'education' END,
   CASE WHEN n_skill > 0 THEN 'skills' END, CASE WHEN n_proj > 0 THEN 'projects' END, CASE WHEN n_lang > 0 THEN 'languages' END) AS found FROM cv_flat""", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", F.array_join(rp.detected_sections(), ",").alias("found"))


@query("e17_job_title", f"SELECT doc_id, {JOB_TITLE} AS job_title FROM cv_flat", uses=("cv_flat",))
def _(t):
    return t.cv.select("doc_id", "job_title")


@query("e16_job_title_extract", "SELECT doc_id, title FROM cv_flat", uses=("cv_flat",))
def _(t):
    head = F.substring_index(F.col("text"), "\n\n", 1)
    return t.cv_text.select("doc_id", tx.job_title_from(head).alias("title"))


_SKJ = f"array_to_string({SKILL_LIST}, ', ')"


@query("e26_section_text", rf"""WITH b AS (SELECT *, list_filter({_BODY_LINES}, lambda x: x <> '') AS bl FROM cv_flat) SELECT doc_id, summary,
   nullif(concat_ws(chr(10), CASE WHEN n_exp >= 1 THEN concat_ws(chr(10), e1_title || ' — ' || e1_company || ' — ' || split_part('{_EN}', ',', e1_sm) || ' ' || e1_sy || ' – Present', nullif(array_to_string(bl, chr(10)), '')) END,
     CASE WHEN n_exp >= 2 THEN e2_title || ' — ' || e2_company || ' — ' || split_part('{_EN}', ',', e2_sm) || ' ' || e2_sy || ' - ' || split_part('{_EN}', ',', e2_em) || ' ' || e2_ey || chr(10) || e2_bullet END,
     CASE WHEN n_exp >= 3 THEN e3_title || ' — ' || e3_company || ' — ' || e3_sy || ' - ' || e3_ey END), '') AS experience, concat_ws(chr(10), name, title, email, phone, city) AS header, CASE WHEN n_skill > 0 THEN {_SKJ} END AS skills,
   CASE n_edu WHEN 1 THEN d1_degree || ' ' || d1_school || ' ' || d1_sy || ' - ' || d1_ey WHEN 2 THEN d1_degree || ' ' || d1_school || ' ' || d1_sy || ' - ' || d1_ey || chr(10) || d2_school || ' ' || d2_sy || ' - ' || d2_ey END AS education,
   CASE n_proj WHEN 1 THEN p1_name WHEN 2 THEN p1_name || chr(10) || p2_name END AS projects, CASE n_lang WHEN 1 THEN 'Français' WHEN 2 THEN 'Français, Anglais' END AS languages FROM b""", uses=("cv_flat",))
def _(t):
    s = F.col("sections")
    return t.cv.select("doc_id", *[F.try_element_at(s, F.lit(k)).alias(k) for k in ("header", "summary", "experience", "skills", "education", "projects", "languages")])


@query("e27_rebuilt_text", rf"""WITH b AS (SELECT *, list_filter({_BODY_LINES}, lambda x: x <> '') AS bl FROM cv_flat) SELECT doc_id, concat_ws(' ', name, title, city, summary, nullif(array_to_string({SKILL_LIST}, ' '), ''),
   CASE WHEN n_exp >= 1 THEN concat_ws(' ', e1_title, e1_company, split_part('{_EN}', ',', e1_sm) || ' ' || e1_sy || ' – Present', nullif(array_to_string(bl, ' '), '')) END,
   CASE WHEN n_exp >= 2 THEN concat_ws(' ', e2_title, e2_company, split_part('{_EN}', ',', e2_sm) || ' ' || e2_sy || ' - ' || split_part('{_EN}', ',', e2_em) || ' ' || e2_ey, e2_bullet) END,
   CASE WHEN n_exp >= 3 THEN concat_ws(' ', e3_title, e3_company, e3_sy || ' - ' || e3_ey) END, CASE WHEN n_edu >= 1 THEN concat_ws(' ', d1_degree, d1_school, 'hadoop') END,
   CASE WHEN n_edu >= 2 THEN d2_school END, CASE WHEN n_proj >= 1 THEN concat_ws(' ', p1_name, p1_desc, 'docker', split_part('python,scala,rust,java', ',', CAST(1 + doc_id % 4 AS INT)), p1_metric) END,
   CASE WHEN n_proj >= 2 THEN concat_ws(' ', p2_name, p2_desc, 'php') END) AS text FROM b""", uses=("cv_flat",))
def _(t):
    c = F.col
    return t.cv.select("doc_id", rec.rebuilt_text(c("header"), c("summary"), c("skills"), c("experience"), c("education"), c("projects")).alias("text"))


_NW = rf"(SELECT doc_id, {WC} AS nw, CAST(floor({WC} * CASE n_chars % 3 WHEN 0 THEN 1.3 WHEN 1 THEN 1.05 ELSE 0.4 END) AS INT) AS ow, n_skill, n_chars FROM cv_text)"


@query("p3_extraction_cascade", rf"""WITH x AS {_NW}, y AS (SELECT *, round(least(1.0, nw / 450.0), 2) AS nc, round(least(1.0, ow / 450.0), 2) AS oc, ow > nw * 1.1 AND ow >= 150 AS wins,
     CASE WHEN n_chars % 2 = 0 THEN n_skill * 10.0 END AS mr FROM x),
   z AS (SELECT *, CASE WHEN wins THEN true WHEN nw >= 150 THEN false ELSE ow >= nw END AS uo, CASE WHEN wins THEN oc WHEN nw >= 150 THEN nc ELSE greatest(nc, oc) END AS bc FROM y)
   SELECT doc_id, CASE WHEN nc >= 0.85 THEN 'pdfplumber' WHEN bc >= 0.85 THEN CASE WHEN uo THEN 'ocr' ELSE 'pdfplumber' END WHEN mr > 50 THEN 'vision_llm' WHEN uo AND ow >= 30 THEN 'ocr' ELSE 'pdfplumber' END AS method,
     CASE WHEN nc >= 0.85 THEN nc WHEN bc >= 0.85 THEN bc WHEN mr > 50 THEN 0.95 WHEN uo AND ow >= 30 THEN bc WHEN nw >= 30 THEN nc ELSE 0 END AS confidence FROM z""", uses=CV)
def _(t):
    n = tx.word_count(tx.clean_blanks(F.col("text")))
    k = F.col("n_chars") % 3
    x = t.cv_text.select("doc_id", n.alias("nw"), F.floor(n * F.when(k == 0, 1.3).when(k == 1, 1.05).otherwise(0.4)).alias("ow"),
                         F.when(F.col("n_chars") % 2 == 0, F.col("n_skill") * 10.0).alias("mr"))
    return x.select("doc_id", cascade.choose_extraction(F.col("nw"), F.col("ow"), F.lit(50.0), F.col("mr")).alias("r")).select("doc_id", "r.*")


# --- report -----------------------------------------------------------------------------------
METRIC_TEXT = rf"""concat(concat_ws(' ', CASE WHEN n_exp >= 1 THEN array_to_string({_BODY_LINES}, ' ') END, CASE WHEN n_exp >= 2 THEN e2_bullet END), CASE WHEN n_proj >= 1 THEN p1_metric ELSE '' END)"""
HAS_METRICS = "(" + " OR ".join(f"regexp_matches(mt, '{p}')" for p in lx.METRIC_PATTERNS) + ")"
_ACT = ", ".join("'" + w.replace("'", "''") + "'" for w in lx.action_words())
BULLETS = rf"lower(concat_ws(' ', CASE WHEN n_exp >= 1 THEN array_to_string({_BODY_LINES}, ' ') END, CASE WHEN n_exp >= 2 THEN e2_bullet END))"
HAS_VERBS = rf"len(list_filter(regexp_extract_all(CASE WHEN bt <> '' THEN bt ELSE lower(text) END, '[\p{{L}}\p{{N}}_]+'), lambda x: x IN ({_ACT}))) > 0"
SIGNALS = f"""s0 AS (SELECT *, {METRIC_TEXT} AS mt, {BULLETS} AS bt, {WC} AS wc FROM cv_text), sg AS (SELECT *, {HAS_METRICS} AS hm, {HAS_VERBS} AS hv, n_exp >= 1 AS hd FROM s0),
   ss AS (SELECT *, CASE WHEN wc >= 300 THEN 15 ELSE 0 END + CASE WHEN n_skill >= 10 THEN 20 ELSE 0 END + CASE WHEN n_exp >= 1 THEN 15 ELSE 0 END + CASE WHEN summary IS NOT NULL THEN 10 ELSE 0 END
     + CASE WHEN hd THEN 10 ELSE 0 END + CASE WHEN hv THEN 10 ELSE 0 END + CASE WHEN hm THEN 10 ELSE 0 END + CASE WHEN n_proj > 0 THEN 10 ELSE 0 END AS strength FROM sg)"""
LEVEL = "CASE WHEN strength >= 75 THEN 'Solide' WHEN strength >= 50 THEN 'Correct' ELSE 'À renforcer' END"


def signals(t):
    return rp.with_signals(t.cv)


@query("a4_profile_strength", f"WITH {SIGNALS} SELECT doc_id, strength, {LEVEL} AS level, hm AS has_metrics, hv AS has_verbs FROM ss", uses=CV)
def _(t):
    return signals(t).withColumn("strength", rp.strength_score()).select("doc_id", "strength", rp.level(F.col("strength")).alias("level"), "has_metrics", "has_verbs")


@query("p22_score_bands", """SELECT o_orderkey, CASE WHEN x >= 70 THEN '#22c55e' WHEN x >= 50 THEN '#f59e0b' ELSE '#ef4444' END AS colour, CASE WHEN x >= 70 THEN '🟢' WHEN x >= 45 THEN '🟡' ELSE '🔴' END AS light,
   CASE WHEN x >= 75 THEN 'Solide' WHEN x >= 50 THEN 'Correct' ELSE 'À renforcer' END AS level FROM (SELECT o_orderkey, o_totalprice / 5000 AS x FROM orders)""")
def _(t):
    x = F.col("o_totalprice") / 5000
    return t.orders.select("o_orderkey", rp.score_colour(x).alias("colour"), rp.score_light(x).alias("light"), rp.level(x).alias("level"))


@query("e30_readability", f"SELECT doc_id, CASE layout WHEN 'single_column' THEN '✅ Optimal' ELSE '⚠️ Risque parseur' END AS label, method, {WC} >= 150 AS readable FROM cv_text", uses=CV)
def _(t):
    return t.cv.select("doc_id", rp.readability_label(F.col("layout_detected")).alias("label"), F.col("extraction_method").alias("method"),
                       (F.col("word_count") >= 150).alias("readable"))


_YEARS = f"(SELECT doc_id, round(sum(months) / 12, 1) AS yrs FROM ({EXPS}) GROUP BY doc_id)"


@query("e31_strengths", f"""WITH {SIGNALS} SELECT ss.doc_id, concat_ws('|', CASE WHEN n_skill >= 10 THEN 'Compétences techniques riches (' || n_skill || ' skills détectés)' END,
   CASE WHEN n_exp >= 1 THEN 'Expérience réelle (' || e1_title || ' @ ' || e1_company || ', ' || CAST(round_even(yrs, 0) AS INT) || ' an(s))' END, CASE WHEN summary IS NOT NULL THEN 'Accroche/profil présent' END,
   CASE WHEN hm THEN 'Métriques chiffrées dans les expériences' END, CASE WHEN n_proj > 0 THEN n_proj || ' projet(s) documenté(s)' END, CASE WHEN wc >= 300 THEN 'CV bien développé (' || wc || ' mots)' END) AS strengths,
   concat_ws('|', CASE WHEN n_skill < 10 THEN 'Enrichir les compétences techniques (' || n_skill || ' détectées, cible ≥ 10)' END, CASE WHEN n_exp < 1 THEN 'Ajouter une expérience professionnelle' END,
   CASE WHEN summary IS NULL THEN 'Ajouter une accroche/profil en tête de CV' END, CASE WHEN NOT hm THEN 'Quantifier les résultats dans les expériences (%, chiffres, volumes)' END,
   CASE WHEN n_proj = 0 THEN 'Créer une section Projets avec stack et résultats' END, CASE WHEN wc < 300 THEN 'Développer le contenu (' || wc || ' mots détectés, cible ≥ 300)' END) AS improvements
   FROM ss LEFT JOIN {_YEARS} y ON y.doc_id = ss.doc_id""", uses=CV)
def _(t):
    return signals(t).select("doc_id", F.array_join(rp.strengths(), "|").alias("strengths"), F.array_join(rp.improvements(), "|").alias("improvements"))


_REC = f"""rc AS (SELECT doc_id, unnest([x FOR x IN [
   CASE WHEN layout = 'two_columns' THEN {{'p': 1, 'o': 1, 'a': 'Convertir en 1 colonne'}} END, CASE WHEN n_exp = 0 THEN {{'p': 1, 'o': 2, 'a': 'Ajouter une section « Expérience professionnelle »'}} END,
   CASE WHEN n_edu = 0 THEN {{'p': 1, 'o': 3, 'a': 'Ajouter une section « Formation »'}} END, CASE WHEN n_skill = 0 THEN {{'p': 1, 'o': 4, 'a': 'Ajouter une section « Compétences »'}} END,
   CASE WHEN NOT hm AND n_exp > 0 THEN {{'p': 2, 'o': 5, 'a': 'Ajouter des métriques chiffrées dans les expériences'}} END, CASE WHEN n_proj = 0 AND n_exp > 0 THEN {{'p': 2, 'o': 6, 'a': 'Créer une section Projets avec stack et résultats'}} END,
   CASE WHEN summary IS NULL THEN {{'p': 2, 'o': 7, 'a': 'Ajouter une accroche/profil en début de CV'}} END, CASE WHEN NOT hv THEN {{'p': 3, 'o': 9, 'a': 'Débuter les bullets par des verbes ou noms d''action'}} END,
   CASE WHEN n_skill < 10 THEN {{'p': 3, 'o': 10, 'a': 'Enrichir les compétences (' || n_skill || ' détectées, cible ≥ 10)'}} END, CASE WHEN wc < 300 THEN {{'p': 3, 'o': 11, 'a': 'Développer le contenu du CV (' || wc || ' mots, cible ≥ 300)'}} END,
   CASE WHEN n_chars % 10 > 3 THEN {{'p': 3, 'o': 12, 'a': 'Réduire la répétition de mots-clés techniques'}} END] IF x IS NOT NULL]) AS r FROM sg)"""


@query("e32_recommendations", f"WITH {SIGNALS}, {_REC} SELECT doc_id, r.p AS priority, r.a AS action FROM rc", uses=CV)
def _(t):
    density = (F.length("raw_text") * 0 + (F.col("n_chars") % 10) / 10.0)
    cv = signals(t).join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return cv.select("doc_id", F.explode(rp.recommendations(density)).alias("r")).select("doc_id", "r.priority", "r.action")


@query("t6_recommendations_by_priority", f"WITH {SIGNALS}, {_REC} SELECT doc_id, r.a AS action, row_number() OVER (PARTITION BY doc_id ORDER BY r.p, r.o) AS pos FROM rc", uses=CV)
def _(t):
    cv = signals(t).join(t.documents.select("doc_id", "n_chars"), "doc_id")
    keyed = F.sort_array(F.transform(rp.recommendations((F.col("n_chars") % 10) / 10.0), lambda r, i: F.struct(r["priority"].alias("p"), i.alias("i"), r["action"].alias("a"))))
    return cv.select("doc_id", F.posexplode(keyed).alias("i", "r")).select("doc_id", F.col("r.a").alias("action"), (F.col("i") + 1).alias("pos"))


@query("m5_quality_report", f"""WITH {SIGNALS}, {_IV}, n AS (SELECT doc_id, e, lead(s) OVER (PARTITION BY doc_id ORDER BY s, i) AS nx FROM iv), g AS (SELECT doc_id, count(*) AS gaps FROM n WHERE nx - e > 12 GROUP BY doc_id)
   SELECT ss.doc_id, strength, {LEVEL} AS level, coalesce(gaps, 0) AS gaps, coalesce(yrs, 0) AS years, wc >= 150 AS readable,
     (CASE WHEN n_exp = 0 THEN 1 ELSE 0 END + CASE WHEN n_edu = 0 THEN 1 ELSE 0 END + CASE WHEN n_skill = 0 THEN 1 ELSE 0 END) AS sections_missing
   FROM ss LEFT JOIN g ON g.doc_id = ss.doc_id LEFT JOIN {_YEARS} y ON y.doc_id = ss.doc_id""", uses=CV)
def _(t):
    from sparkfolio.plans.report import quality_report
    return quality_report(t.cv, AS_OF).select("doc_id", "strength", "level", F.size("career_gaps").alias("gaps"), F.col("total_experience_years").alias("years"),
                                             F.col("is_machine_readable").alias("readable"), F.size("sections_missing").alias("sections_missing"))

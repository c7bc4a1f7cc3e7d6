"""Word tables, lexicon building, sources, sinks, locations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.catalog.derived import AS_OF, pick
from sparkfolio.catalog.hashing import vectors_sql
from sparkfolio.catalog.q_matching import JOB_TITLE, SKILL_LIST
from sparkfolio.catalog.q_records import WC
from sparkfolio.catalog.q_text import HIT, LEX_SQL, ranked_sql
from sparkfolio.catalog.registry import query
from sparkfolio.functions import contact
from sparkfolio.functions import skills as sk
from sparkfolio.functions import text as tx
from sparkfolio.operators import keywords as kw
from sparkfolio.operators import layout as lo
from sparkfolio.operators import lexicon_build as lb
from sparkfolio.operators import records as rec
from sparkfolio.operators.segments import flat_sections
from sparkfolio.session import scratch_dir
from sparkfolio.sources import logs
from sparkfolio.sources.cv_json import read_cv_json
from sparkfolio.sources.words import parse_words
from sparkfolio.streaming import jobs

# --- positioned words stated from document lines ----------------------------------------------
_WORDS = """wd AS (SELECT doc_id, n_chars, i, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS j FROM (SELECT doc_id, n_chars, i, string_split(line, ' ') AS ws FROM
     (SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents))),
   wp AS (SELECT doc_id, i, j, text, i // 40 AS page, (CASE WHEN n_chars % 2 = 0 AND j >= 6 THEN 310 + 12 * (j - 6) ELSE 50 + 12 * j END)::DOUBLE AS x0, (100 + 15 * (i % 40) + j % 3)::DOUBLE AS top,
     CASE WHEN i = 0 THEN 14.0 WHEN i % 4 = 1 THEN 11.04 ELSE 10.0 END AS size, CASE WHEN i % 5 = 0 THEN 'Helvetica-Bold' ELSE 'Helvetica' END AS fontname FROM wd WHERE text <> ''),
   wo AS (SELECT *, x0 + 10 AS x1, top + 10 AS bottom FROM wp)"""


def words_of(t):
    d = t.documents.select("doc_id", "n_chars", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    d = d.select("doc_id", "n_chars", "i", F.posexplode(F.split("line", " ")).alias("j", "text")).filter("text <> ''")
    x0 = F.when((F.col("n_chars") % 2 == 0) & (F.col("j") >= 6), 310 + 12 * (F.col("j") - 6)).otherwise(50 + 12 * F.col("j")).cast("double")
    top = (100 + 15 * (F.col("i") % 40) + F.col("j") % 3).cast("double")
    return d.select("doc_id", "i", F.floor(F.col("i") / 40).cast("int").alias("page"), "text", x0.alias("x0"), (x0 + 10).alias("x1"), top.alias("top"), (top + 10).alias("bottom"),
                    F.when(F.col("i") == 0, 14.0).when(F.col("i") % 4 == 1, 11.04).otherwise(10.0).alias("size"),
                    F.when(F.col("i") % 5 == 0, "Helvetica-Bold").otherwise("Helvetica").alias("fontname"))


_GUT = f"""{_WORDS}, sz AS (SELECT doc_id, max(x1) AS width, 0.2 * max(bottom) AS body_top FROM wo GROUP BY doc_id),
   bx AS (SELECT wo.doc_id, round(x0, 1) AS x, width, count(*) AS n FROM wo JOIN sz USING (doc_id) WHERE top > body_top GROUP BY ALL),
   ce AS (SELECT doc_id, x, lead(x) OVER (PARTITION BY doc_id ORDER BY x) AS nx FROM bx WHERE x BETWEEN 0.15 * width AND 0.85 * width),
   gp AS (SELECT doc_id, x, nx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY nx - x DESC, x) AS r FROM ce WHERE nx IS NOT NULL) WHERE r = 1 AND nx - x >= 25),
   sd AS (SELECT bx.doc_id, (gp.x + gp.nx) / 2 AS gutter, sum(n) AS total, sum(CASE WHEN bx.x < (gp.x + gp.nx) / 2 THEN n ELSE 0 END) AS lft FROM bx JOIN gp USING (doc_id) GROUP BY ALL),
   gu AS (SELECT sz.doc_id, width, body_top, gutter FROM sz LEFT JOIN (SELECT * FROM sd WHERE total >= 5 AND lft >= total * 0.1 AND total - lft >= total * 0.1) s USING (doc_id)),
   wl AS (SELECT wo.*, gutter, body_top, min(top) OVER (PARTITION BY doc_id, page, i) AS anchor FROM wo JOIN gu USING (doc_id)),
   wc AS (SELECT *, CASE WHEN gutter IS NULL OR anchor < body_top THEN 'full' WHEN x0 < gutter THEN 'left' ELSE 'right' END AS col FROM wl),
   li AS (SELECT doc_id, page, anchor, col, string_agg(text, ' ' ORDER BY x0) AS text, max(size) AS size, bool_or(fontname LIKE '%Bold') AS bold, min(x0) AS x0, min(top) AS top FROM wc GROUP BY ALL)"""


@query("s2_word_scan", f"WITH {_WORDS} SELECT doc_id, page, count(*) AS words, max(x1) AS width FROM wo GROUP BY doc_id, page")
def _(t):
    return words_of(t).groupBy("doc_id", "page").agg(F.count("*").alias("words"), F.max("x1").alias("width"))


@query("a17_document_layout", f"WITH {_GUT} SELECT doc_id, width, round(body_top, 4) AS body_top, CASE WHEN gutter IS NULL THEN 'single_column' ELSE 'two_columns' END AS layout FROM gu")
def _(t):
    return lo.gutters(words_of(t)).select("doc_id", "width", F.round("body_top", 4).alias("body_top"), "layout")


@query("w2_column_gutter", f"WITH {_GUT} SELECT doc_id, gutter FROM gu WHERE gutter IS NOT NULL")
def _(t):
    return lo.gutters(words_of(t)).filter("gutter is not null").select("doc_id", "gutter")


@query("w4_line_grouping", f"WITH {_WORDS} SELECT doc_id, page, min(top) AS anchor, count(*) AS words FROM wo GROUP BY doc_id, page, i")
def _(t):
    w = words_of(t)
    return w.join(lo.line_anchors(w), ["doc_id", "page", "top"]).groupBy("doc_id", "page", "anchor").agg(F.count("*").alias("words"))


def _lines(t):
    return lo.assemble_lines(words_of(t))


@query("a18_line_assembly", f"WITH {_GUT} SELECT doc_id, page, anchor, col, text, size, bold, x0, top FROM li")
def _(t):
    return _lines(t).select("doc_id", "page", "anchor", "col", "text", "size", "bold", "x0", "top")


@query("w5_reading_order", f"""WITH {_GUT} SELECT doc_id, page, anchor, col, row_number() OVER (PARTITION BY doc_id ORDER BY page, CASE col WHEN 'full' THEN 0 WHEN 'left' THEN 1 ELSE 2 END, anchor) AS pos FROM li""")
def _(t):
    return lo.reading_order(_lines(t))


@query("a16_body_size", f"""WITH {_GUT}, ls AS (SELECT doc_id, round(size, 1) AS s, count(*) AS n, min(page * 1000000 + CASE col WHEN 'full' THEN 0 WHEN 'left' THEN 100000 ELSE 200000 END + anchor) AS f FROM li GROUP BY ALL)
   SELECT doc_id, s AS body_size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) AS r FROM ls) WHERE r = 1""")
def _(t):
    return lo.body_sizes(_lines(t).withColumn("key", lo.reading_key()), F.col("key")).select("doc_id", "body_size")


@query("w6_top_lines", f"""WITH {_GUT}, tl AS (SELECT doc_id, list_sort(list(top)) AS ts FROM li GROUP BY doc_id), th AS (SELECT doc_id, ts[1 + CAST(floor(len(ts) * 0.12) AS INT)] AS head_top FROM tl)
   SELECT li.doc_id, page, col, anchor FROM li JOIN th USING (doc_id) WHERE top <= head_top""")
def _(t):
    return lo.top_lines(_lines(t))


@query("s2_word_records", f"WITH {_GUT} SELECT gu.doc_id, CASE WHEN gutter IS NULL THEN 'single_column' ELSE 'two_columns' END AS layout, {WC.replace('text', 'd.text')} AS word_count FROM gu JOIN documents d ON d.doc_id = gu.doc_id")
def _(t):
    return parse_words(words_of(t).drop("i"), AS_OF, fields=["word_count"]).select("doc_id", F.col("layout_detected").alias("layout"), "word_count")


@query("j9_split_name", "SELECT doc_id, CASE WHEN lang = 'de' THEN split_part(name, ' ', 1) ELSE name END AS name FROM cv_flat", uses=("cv_flat",))
def _(t):
    first, last = F.split_part("name", F.lit(" "), F.lit(1)), F.split_part("name", F.lit(" "), F.lit(2))

    def line(text, size, top, col):
        return F.struct(text.alias("text"), F.lit(size).alias("size"), F.lit(False).alias("bold"), F.lit(0.0).alias("x0"), F.lit(top).cast("double").alias("top"), F.lit(col).alias("col"))

    far = F.struct(last.alias("text"), F.lit(18.0).alias("size"), F.lit(False).alias("bold"), F.lit(0.0).alias("x0"), F.when(F.col("lang") == "de", 90.0).otherwise(60.0).alias("top"), F.lit("right").alias("col"))
    lines = F.array(line(F.lit("Curriculum"), 9.0, 10.0, "full"), line(first, 20.0, 50.0, "left"), line(F.lit("x@mail.example.org"), 10.0, 52.0, "right"), far)
    return t.cv_flat.select("doc_id", rec.header_record(lines, F.lit(""))["name"].alias("name"))


@query("j9_band_pairs", f"""WITH {_GUT} SELECT a.doc_id, a.page, a.anchor AS left_at, b.anchor AS right_at FROM li a JOIN li b ON a.doc_id = b.doc_id AND a.page = b.page
   AND a.col = 'left' AND b.col = 'right' AND abs(a.top - b.top) <= 15""")
def _(t):
    lines = _lines(t).select("doc_id", "page", "anchor", "col", "top")
    pairs = lo.band_pairs(lines.filter("col = 'left'"), lines.filter("col = 'right'"), ["doc_id", "page"], "top", 15.0)
    return pairs.select("left.doc_id", "left.page", F.col("left.anchor").alias("left_at"), F.col("right.anchor").alias("right_at"))


# --- flat text and places ---------------------------------------------------------------------
_FLAT = "lower(name) || ' mail phone ' || replace(body, chr(10), ' ') || ' professional experience ' || lower(e2_bullet) || ' technical skills python docker education ' || lower(d1_degree)"


@query("e28_flat_sections", rf"""SELECT doc_id, 'header' AS section, array_to_string(regexp_extract_all(lower(name) || ' mail phone ' || replace(body, chr(160), ' '), '\S+'), ' ') AS content FROM cv_flat
   UNION ALL SELECT doc_id, 'experience', lower(e2_bullet) FROM cv_flat UNION ALL SELECT doc_id, 'skills', 'python docker' FROM cv_flat UNION ALL SELECT doc_id, 'education', lower(d1_degree) FROM cv_flat""", uses=("cv_flat",))
def _(t):
    return t.cv_flat.select("doc_id", F.explode(flat_sections(F.expr(_FLAT))).alias("c")).select("doc_id", "c.section", "c.content")


_RAW = """CASE doc_id % 3 WHEN 0 THEN '12 avenue Foch' || chr(10) || postal || ' ' || replace(city, '-En-', '-en-') WHEN 1 THEN 'habite ' || city || ', ' || postal || ' .' ELSE 'Jean Jaurès, 59000 .' END"""


@query("e5_location_cascade", "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'Metz' ELSE city END AS city, CASE WHEN lang = 'fr' THEN '57000' ELSE postal END AS code FROM cv_flat", uses=("cv_flat",))
def _(t):
    fr = F.col("lang") == "fr"
    title = F.when(F.col("doc_id") % 3 == 2, F.concat_ws(" ", F.lit("Vendeur"), "postal", "city"))
    p = contact.cascade_location(F.when(fr, "Metz"), F.when(fr, "57000"), F.expr(_RAW), title, F.lit(None).cast("string"))
    return t.cv_flat.select("doc_id", p.alias("p")).select("doc_id", "p.city", "p.code")


@query("e6_entity_location", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Brest' ELSE city || ' Centre' END AS city FROM cv_flat", uses=("cv_flat",))
def _(t):
    cands = F.array(F.lit("Français"), F.concat(F.col("city"), F.lit(" Centre")), F.lit("rue Haute"), F.lit("Brest"))
    head = F.expr("CASE doc_id % 3 WHEN 0 THEN 'CV, Brest' WHEN 1 THEN 'CV ' || city || ' Centre puis Brest' ELSE 'CV' END")
    return t.cv_flat.select("doc_id", contact.entity_location(head, cands).alias("city"))


@query("t9_earliest_in_header", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN e2_company ELSE 'Quimper' END AS place FROM cv_flat", uses=("cv_flat",))
def _(t):
    cands = F.array(F.lit("Quimper"), F.col("e2_company"))
    head = F.expr("CASE WHEN doc_id % 2 = 0 THEN 'de ' || e2_company || ' vers Quimper' ELSE 'de Quimper vers ' || e2_company END")
    return t.cv_flat.select("doc_id", contact.entity_location(head, cands).alias("place"))


@query("t8_longest_proper_run", r"""WITH r AS (SELECT doc_id, unnest(rs) AS r, generate_subscripts(rs, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-ZÀ-Ý][\p{L}\p{N}_''-]*(?:[\s,-]+[A-ZÀ-Ý][\p{L}\p{N}_''-]*)*') AS rs FROM documents)),
   b AS (SELECT doc_id, regexp_replace(r, '^[ ,\-]+|[ ,\-]+$', '', 'g') AS run FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length(r) DESC, i) AS k FROM r) WHERE k = 1)
   SELECT d.doc_id, run FROM documents d LEFT JOIN b ON b.doc_id = d.doc_id""")
def _(t):
    return t.documents.select("doc_id", contact.longest_proper_run(F.col("text")).alias("run"))


@query("u7_ordered_distinct", r"""WITH w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, regexp_extract_all(replace(text, chr(160), ' '), '\S+') AS ws FROM documents)),
   f AS (SELECT doc_id, w, min(i) AS i FROM w GROUP BY doc_id, w) SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY doc_id""")
def _(t):
    return kw.ordered_distinct(t.documents)


_ACT = ", ".join("'" + w.replace("'", "''") + "'" for w in lx.action_words())


@query("u3_action_words_found", rf"""WITH w AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS w FROM cv_text) WHERE w IN ({_ACT}))
   SELECT c.doc_id, coalesce(string_agg(w, ',' ORDER BY w), '') AS found FROM cv_text c LEFT JOIN w ON w.doc_id = c.doc_id GROUP BY c.doc_id""", uses=("cv_text",))
def _(t):
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    return t.cv_text.select("doc_id", F.array_join(F.sort_array(F.array_intersect(tokens, tx.lit_array(lx.action_words()))), ",").alias("found"))


@query("u2_exact_and_semantic_skills", f"SELECT doc_id, concat_ws(',', nullif(array_to_string({SKILL_LIST}, ','), ''), CASE WHEN n_skill < 2 THEN 'Docker' END, 'team work') AS skills FROM cv_flat", uses=("cv_flat",))
def _(t):
    extra = tx.lit_array(["Docker", "team work"])
    have = F.transform("skills_flat", F.lower)
    return t.cv.select("doc_id", F.array_join(F.concat("skills_flat", F.filter(extra, lambda x: ~F.array_contains(have, F.lower(x)))), ",").alias("skills"))


_BLOCK = ", ".join("('" + w.replace("'", "''") + "')" for w in lx.LOCATION_BLOCKLIST)


@query("j10_blocklist_anti_join", rf"""WITH w AS (SELECT DISTINCT doc_id, w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM cv_text))
   SELECT doc_id, count(*) AS kept FROM w WHERE w NOT IN (SELECT * FROM (VALUES {_BLOCK})) GROUP BY doc_id""", uses=("cv_text",))
def _(t):
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    words = t.cv_text.select("doc_id", F.explode(tokens).alias("word"))
    block = t.spark.createDataFrame([(w,) for w in lx.LOCATION_BLOCKLIST], "word string")
    return lb.new_words(words, block, "word").groupBy("doc_id").agg(F.count("*").alias("kept"))


# --- lexicon jobs -----------------------------------------------------------------------------
_RAW_SKILL = f"{pick('use,develop,Manage,knowledge of,analyse', 'p_partkey')} || ' ' || CASE p_size % 4 WHEN 0 THEN {pick('python,cloud storage,data mining,neural nets,etl,docker,welding,data,tools', 'p_partkey')} WHEN 1 THEN p_name ELSE p_name || ' ' || lower(p_type) END"
_VERB = lx.SKILL_VERB_PREFIX
_NORM = rf"regexp_replace(lower(trim(raw)), '{_VERB}', '')"
_GENERIC = ", ".join(f"'{w}'" for w in lx.GENERIC_SKILL_WORDS)
_NORMALISED = f"nz AS (SELECT p_partkey, CASE WHEN c = '' OR len(string_split(c, ' ')) > 3 OR c IN ({_GENERIC}) THEN NULL ELSE c END AS skill FROM (SELECT p_partkey, {_NORM} AS c FROM (SELECT p_partkey, {_RAW_SKILL} AS raw FROM part)))"
_CAT = "CASE " + " ".join("WHEN " + " OR ".join(f"regexp_matches(skill, '{p}')" for p in ps) + f" THEN '{c}'" for c, ps in lx.CATEGORY_PATTERNS.items()) + " ELSE 'other' END"


@query("e20_skill_normalise", f"WITH {_NORMALISED} SELECT p_partkey, skill FROM nz")
def _(t):
    return t.part.select("p_partkey", sk.normalise_skill(F.expr(_RAW_SKILL)).alias("skill"))


@query("e21_skill_categorise", f"WITH {_NORMALISED} SELECT p_partkey, {_CAT} AS category FROM nz WHERE skill IS NOT NULL")
def _(t):
    return t.part.select("p_partkey", sk.normalise_skill(F.expr(_RAW_SKILL)).alias("skill")).filter("skill is not null").select(
        "p_partkey", sk.categorise_skill(F.col("skill")).alias("category"))


def _lexicon_json(t):
    return t.part.select("p_partkey", F.to_json(F.struct(F.create_map(F.lower("p_type"), F.array("p_name", F.initcap("p_name"), F.lower("p_brand"))).alias("skill_categories"))).alias("json"))


_LEXROWS = "lr AS (SELECT p_partkey, lower(p_type) AS category, p_name AS skill, 0 AS pos FROM part UNION ALL SELECT p_partkey, lower(p_type), upper(substr(p_name, 1, 1)) || substr(split_part(p_name, ' ', 1), 2) || ' ' || upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2), 1 FROM part UNION ALL SELECT p_partkey, lower(p_type), lower(p_brand), 2 FROM part)"
_BASEROWS = "br AS (SELECT -1 AS p_partkey, 'base' AS category, 'Brand#7' AS skill, 0 AS pos UNION ALL SELECT -1, 'base', 'red ring', 1)"


def _base_rows(t):
    return t.spark.createDataFrame([("base", "Brand#7", -1, 0), ("base", "red ring", -1, 1)], "category string, skill string, p_partkey bigint, pos int")


@query("s7_lexicon_merge", f"""WITH {_LEXROWS}, {_BASEROWS}, un AS (SELECT 0 AS part, * FROM br UNION ALL SELECT 1, * FROM lr)
   SELECT category, skill, part FROM (SELECT *, row_number() OVER (PARTITION BY lower(skill) ORDER BY part, p_partkey, pos) AS r FROM un) WHERE r = 1""")
def _(t):
    rows = lb.lexicon_rows(_lexicon_json(t), "json", ["p_partkey"])
    return lb.merge_rows([_base_rows(t), rows], ["p_partkey", "pos"], ignore_case=True, per_category=False).select("category", "skill", "part")


@query("u1_lexicon_union", f"""WITH {_LEXROWS} SELECT category, skill, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY category, skill ORDER BY p_partkey, pos) AS r FROM lr) WHERE r = 1""")
def _(t):
    return lb.merge_rows([lb.lexicon_rows(_lexicon_json(t), "json", ["p_partkey"])], ["p_partkey", "pos"]).select("category", "skill", "p_partkey")


@query("u1_incremental_union", f"""WITH {_LEXROWS} SELECT category, skill, p_partkey, p_partkey % 3 AS batch FROM (SELECT *, row_number() OVER (PARTITION BY category, skill ORDER BY p_partkey % 3, p_partkey, pos) AS r FROM lr) WHERE r = 1""")
def _(t):
    rows, path = lb.lexicon_rows(_lexicon_json(t), "json", ["p_partkey"]), scratch_dir(t.spark, "lexicon")
    for batch in (0, 1, 2):
        lb.merge_delta(rows.filter(F.col("p_partkey") % 3 == batch), path, batch, ["p_partkey", "pos"])
    return lb.stored_lexicon(t.spark, path, ["p_partkey", "pos"], "p_partkey long, pos int").select("category", "skill", "p_partkey", "batch")


@query("s9_skill_dataset", f"WITH d AS (SELECT DISTINCT lower(trim({_RAW_SKILL})) AS skill FROM part) SELECT skill, {_CAT} AS category FROM d WHERE len(string_split(skill, ' ')) <= 4")
def _(t):
    return lb.dataset_skills(t.part.select("p_partkey", F.expr(_RAW_SKILL).alias("label")))


def _occupations(t):
    body = F.struct(F.concat(F.lit("uri:"), F.col("p_partkey").cast("string")).alias("uri"), F.initcap("p_name").alias("title"),
                    F.struct(F.array(F.struct(F.expr(_RAW_SKILL).alias("title")), F.struct(F.lit("apply very long skill phrases here").alias("title"))).alias("hasEssentialSkill")).alias("_links"))
    return lb.occupation_skills(t.part.select("p_partkey", F.to_json(body).alias("json")), "json", ["p_partkey"])


@query("s10_occupation_skills", f"WITH {_NORMALISED} SELECT nz.p_partkey, p_name AS title, skill, {_CAT} AS category FROM nz JOIN part ON part.p_partkey = nz.p_partkey WHERE skill IS NOT NULL")
def _(t):
    return _occupations(t).select("p_partkey", "title", "skill", "category")


def _results(t):
    title = F.lower("title")
    q = F.when(F.col("source") == "jooble", F.split_part(title, F.lit(" "), F.lit(2))).otherwise(title)
    noun, role = F.split_part(title, F.lit(" "), F.lit(1)), F.split_part(title, F.lit(" "), F.lit(2))
    found = F.array(F.concat(F.lit("Packing "), role), F.concat(F.initcap(noun), F.lit(" operator")), F.concat(noun, F.lit(" helper")))
    return t.listing.select(F.col("listing_id").alias("query_id"), q.alias("query"), F.posexplode(found).alias("rank", "title"))


@query("j11_best_occupation", "SELECT listing_id AS query_id, CASE WHEN source = 'jooble' THEN 0 ELSE 1 END AS rank, CASE WHEN source = 'jooble' THEN 'packing ' || split_part(title, ' ', 2) ELSE lower(split_part(title, ' ', 1)) || ' operator' END AS title FROM listing", uses=("listing",))
def _(t):
    return lb.best_occupation(_results(t))


@query("u8_multiword_phrases", f"WITH {_NORMALISED} SELECT DISTINCT skill FROM nz WHERE skill LIKE '% %' AND skill <> 'red ring'")
def _(t):
    return lb.phrases(t.part.select(sk.normalise_skill(F.expr(_RAW_SKILL)).alias("skill")), ["red ring"])


_BUILT = f"{_NORMALISED}, bl AS (SELECT DISTINCT category, skill FROM (SELECT {_CAT} AS category, skill FROM nz WHERE skill IS NOT NULL UNION ALL SELECT {_CAT}, skill FROM (SELECT DISTINCT lower(trim({_RAW_SKILL})) AS skill FROM part) WHERE len(string_split(skill, ' ')) <= 4))"


def _built(t):
    return lb.build_lexicon([_occupations(t).select("category", "skill"), lb.dataset_skills(t.part.select(F.expr(_RAW_SKILL).alias("label")))])


@query("m8_build_lexicon", f"WITH {_BUILT} SELECT category, skill FROM bl")
def _(t):
    return _built(t).select("category", "skill")


@query("a23_lexicon_stats", f"WITH {_BUILT} SELECT coalesce(category, 'TOTAL') AS category, count(*) AS skills FROM bl GROUP BY GROUPING SETS ((category), ())")
def _(t):
    return lb.lexicon_stats(_built(t))


@query("m9_sector_keywords", f"""WITH {_NORMALISED} SELECT DISTINCT CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'btp' ELSE 'sport' END AS sector, skill FROM nz JOIN part ON part.p_partkey = nz.p_partkey WHERE skill IS NOT NULL""")
def _(t):
    sectors = t.part.select(F.expr("CASE WHEN p_type IN ('SMALL', 'LARGE') THEN 'btp' ELSE 'sport' END").alias("sector"), F.col("p_partkey").alias("query_id"))
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_partkey").cast("string"))
    results = t.part.select(F.col("p_partkey").alias("query_id"), name.alias("query"), F.lit(1).alias("rank"), name.alias("title"))
    occ = _occupations(t).withColumn("title", F.concat("title", F.lit(" "), F.col("p_partkey").cast("string")))
    return lb.sector_keywords(sectors, results, occ)


# --- sources and sinks ------------------------------------------------------------------------
def _model_json(t):
    lang = F.transform("languages", lambda x, i: F.when(i == 0, F.to_json(F.struct(F.lit(" ").alias("level"), x.alias("name")))).otherwise(F.concat(F.lit('"'), x, F.lit('"'))))
    body = F.to_json(F.struct("header", "summary", "skills", "experience", "education", "projects"))
    body = F.concat(F.expr("substr(b, 1, length(b) - 1)"), F.lit(', "languages": ['), F.array_join(F.col("l"), ", "), F.lit("]}"))
    cv = t.cv.select("doc_id", F.to_json(F.struct("header", "summary", "skills", "experience", "education", "projects")).alias("b"), lang.alias("l")).select("doc_id", body.alias("j"))
    cv = cv.join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return cv.select("doc_id", F.when(F.col("n_chars") % 11 == 0, "Sorry, no answer").otherwise(F.concat(F.lit("Here it is:\n```json\n"), "j", F.lit("\n```\n"))).alias("raw"))


@query("s3_cv_json", "SELECT doc_id, name, n_exp, n_edu, n_proj, CASE n_lang WHEN 0 THEN '' WHEN 1 THEN 'Français' ELSE 'Français,Anglais' END AS languages, summary, 0.95 AS confidence FROM cv_flat WHERE n_chars % 11 <> 0", uses=("cv_flat",))
def _(t):
    rec_, _bad = read_cv_json(_model_json(t), "raw")
    return rec_.select("doc_id", F.col("header.name").alias("name"), F.size("experience").alias("n_exp"), F.size("education").alias("n_edu"), F.size("projects").alias("n_proj"),
                       F.array_join("languages", ",").alias("languages"), "summary", F.col("extraction_confidence").alias("confidence"))


@query("s3_cv_json_quarantine", "SELECT doc_id FROM documents WHERE n_chars % 11 = 0")
def _(t):
    return read_cv_json(_model_json(t), "raw")[1].select("doc_id")


@query("s11_csv_report", f"SELECT doc_id, lang, {WC} AS words FROM documents")
def _(t):
    path = scratch_dir(t.spark, "report")
    logs.write_csv_report(t.documents.select("doc_id", "lang", tx.word_count(tx.clean_blanks(F.col("text"))).alias("words")), path)
    return logs.read_csv_report(t.spark, path, "doc_id bigint, lang string, words int")


@query("s12_lexicon_json", f"WITH {_BUILT} SELECT category, skill FROM bl")
def _(t):
    path = scratch_dir(t.spark, "lexicon")
    logs.write_lexicon(_built(t), path)
    return t.spark.read.schema("category string, skill string").json(path)


def _log_rows(t):
    return _log_columns(t.events)


def _log_columns(e):
    return e.select("ts", F.col("event_type").alias("profile_id"), F.concat(F.lit("s"), (F.col("user_id") % 5).cast("string")).alias("sector"), F.lit("ocr").alias("extraction_method"),
                    (F.col("value") / 100).alias("detection_confidence"), F.col("value").alias("profile_strength_score"), F.col("user_id").cast("double").alias("word_count"), (F.col("value") * 2).alias("latency_ms"))


@query("s13_analysis_log", "SELECT event_type AS profile_id, count(*) AS n, round(sum(value), 4) AS strength FROM events GROUP BY event_type")
def _(t):
    path = scratch_dir(t.spark, "analysis-log")
    logs.append_analysis_log(_log_rows(t), path)
    return t.spark.read.parquet(path).groupBy("profile_id").agg(F.count("*").alias("n"), F.round(F.sum("profile_strength_score"), 4).alias("strength"))


@query("s14_benchmark_log", "SELECT count(*) AS cv_count, round(avg(value), 1) AS avg_time_ms, count(*) FILTER (WHERE event_type = 'error') AS error_count FROM events")
def _(t):
    return logs.benchmark_figures(t.events.select(F.col("value").alias("time_ms"), F.col("event_type").alias("method")))


# --- streams ----------------------------------------------------------------------------------
@query("r1_listing_stream_dedup", "SELECT DISTINCT 'https://jobs.example.org/' || CAST(user_id AS VARCHAR) AS url FROM events")
def _(t):
    s = jobs.file_stream(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)
    s = s.withColumn("url", F.concat(F.lit("https://jobs.example.org/"), F.col("user_id").cast("string")))
    path = scratch_dir(t.spark, "listings")
    jobs.stored_first_seen(s.select("ts", "url"), path, scratch_dir(t.spark, "listings-state")).awaitTermination()
    return t.spark.read.schema("url string").parquet(path).select("url")


@query("s13_analysis_log_stream", "SELECT event_type AS profile_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, round(sum(value), 4) AS strength FROM events GROUP BY ALL")
def _(t):
    stream = jobs.file_stream(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)
    path = scratch_dir(t.spark, "analysis-stream")
    logs.stream_analysis_log(_log_columns(stream), path, scratch_dir(t.spark, "analysis-state")).awaitTermination()
    rows = t.spark.read.schema(logs.ANALYSIS_LOG + ", day date, run string, batch long").parquet(path)
    return rows.groupBy("profile_id", F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("profile_strength_score"), 4).alias("strength"))


@query("r2_windowed_figures", """WITH w AS (SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type, count(*) AS n, round(avg(value), 6) AS avg_value FROM events GROUP BY ALL)
   SELECT CAST(day AS VARCHAR) AS day, event_type, n, avg_value FROM w WHERE day + 1 <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""")
def _(t):
    s = jobs.file_stream(t.spark, f"{t.sf_dir}/events*.parquet", t.events.schema)
    out = jobs.run_available(jobs.windowed_figures(s, "event_type", "value"), "figures")
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("avg_value", 6).alias("avg_value"))


# --- whole pipelines --------------------------------------------------------------------------
_KEYWORDS = ranked_sql("doc_id", r"""SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM cv_text)""", 50)


@query("m7_enrich_text", f"""WITH {LEX_SQL}, sf AS (SELECT doc_id, string_agg(DISTINCT skill, ',' ORDER BY skill) AS skills FROM mk, lex WHERE {HIT} GROUP BY doc_id), {_KEYWORDS.rsplit("SELECT", 1)[0]}, kl AS (SELECT doc_id, string_agg(w, ',' ORDER BY rank) AS keywords FROM rk WHERE rank <= 50 GROUP BY doc_id)
   SELECT doc_id, {JOB_TITLE} AS job_title, city AS location, postal AS postal_code, n_exp, n_lang, coalesce(skills, '') AS skills, coalesce(keywords, '') AS keywords
   FROM cv_flat LEFT JOIN kl USING (doc_id) LEFT JOIN sf USING (doc_id)""", uses=("cv_text",))
def _(t):
    p = rec.parse_text(t.cv_text.select("doc_id", "text"), as_of=AS_OF)
    return rec.enrich(p).select("doc_id", "job_title", "location", "postal_code", F.size("experience").alias("n_exp"), F.size("languages").alias("n_lang"),
                                F.array_join(F.array_sort(F.array_distinct("skills_flat")), ",").alias("skills"), F.array_join("keywords", ",").alias("keywords"))


@query("udf1_hashed_embedding", f"""WITH {vectors_sql("(SELECT text AS txt FROM documents)", 64, kind="DOUBLE")}, v AS (SELECT tid, unnest(vec) AS v, generate_subscripts(vec, 1) - 1 AS place FROM hv)
   SELECT doc_id, place, round(v, 6) AS value FROM documents JOIN v ON tid = md5(text) WHERE v <> 0""")
def _(t):
    from sparkfolio.functions.embedding import hashed_embedding
    return hashed_embedding(t.documents.select("doc_id", "text"), "text", "vector", 64).select("doc_id", F.posexplode("vector").alias("place", "value")).filter(
        "value <> 0").select("doc_id", "place", F.round("value", 6).alias("value"))

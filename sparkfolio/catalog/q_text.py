"""Text, keyword and lexicon queries over documents and over rendered records."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.catalog.registry import query
from sparkfolio.functions import contact
from sparkfolio.functions import text as tx
from sparkfolio.functions.skills import all_skills, alternation_skills, skills_by_category, with_grams
from sparkfolio.operators import keywords as kw

# Words that do occur in the documents, in four languages, plus two-word terms.
FREQUENT = {"en": ["the", "and", "of the", "in the"], "fr": ["que", "les", "de la"], "de": ["und", "der", "die"],
            "es": ["que la", "con", "del"]}
STOPS = ", ".join(f"'{w}'" for w in lx.STOP_WORDS)
W = r"[^\p{L}\p{N}_]"


def sql_values(rows, cols: str) -> str:
    def lit(v):
        if isinstance(v, bool):
            return "true" if v else "false"
        return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + f") AS v({cols})"


def marked(term: str) -> str:
    """A term with every word in brackets, as in MARKED texts."""
    return re.sub(r"\w+", lambda m: "⟦" + m.group() + "⟧", term)


def lexicon_sql(lexicon: dict[str, list[str]]) -> str:
    rows = [(c, s, marked(s), i) for i, (c, s) in enumerate((c, s) for c, v in lexicon.items() for s in v)]
    return f"lex AS (SELECT * FROM {sql_values(rows, 'category, skill, form, ord')})"


def marked_sql(key: str, table: str) -> str:
    return (rf"mk AS MATERIALIZED (SELECT {key}, text, regexp_replace(lower(text), '([\p{{L}}\p{{N}}_]+)', '⟦\1⟧', 'g') AS m "
            rf"FROM {table})")


LEX_SQL = lexicon_sql(lx.SKILLS) + ", " + marked_sql("doc_id", "cv_text")
HIT = ("CASE WHEN skill IN ('c++', 'c#') THEN contains(replace(m, form || '⟦', ''), form) ELSE contains(m, form) END")
# Accented letters count as word characters but never belong to an ASCII keyword.
FOLD = r"regexp_replace(regexp_replace({0}, '[^\x00-\x7F\p{{L}}\p{{N}}]', ' ', 'g'), '[^\x00-\x7F]', '_', 'g')"


def jd_tokens_sql(key: str, text: str, table: str) -> str:
    fold = FOLD.format(text)
    return (rf"SELECT {key}, lower(unnest(ws)) AS w, generate_subscripts(ws, 1) AS pos FROM "
            rf"(SELECT {key}, regexp_extract_all({fold}, '\b[a-zA-Z][a-zA-Z0-9+#.]+\b') AS ws FROM {table})")


def ranked_sql(key: str, tokens: str, k: int) -> str:
    return f"""tok AS ({tokens}),
      cnt AS (SELECT {key}, w, count(*) AS n, min(pos) AS p FROM tok
              WHERE length(w) > 2 AND w NOT IN ({STOPS}) GROUP BY {key}, w),
      rk AS (SELECT {key}, w, n, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, p) AS rank FROM cnt)
      SELECT {key}, rank, w AS term, n FROM rk WHERE rank <= {k}"""


WORDS_SQL = r"len(regexp_extract_all(replace(text, chr(160), ' '), '\S+'))"


@query("a1_word_count", rf"SELECT doc_id, {WORDS_SQL} AS words FROM documents")
def _(t):
    return t.documents.select("doc_id", tx.word_count(F.col("text")).alias("words"))


@query("p1_extraction_confidence", f"SELECT doc_id, round(least(1.0, {WORDS_SQL} / 450.0), 2) AS confidence FROM documents")
def _(t):
    return t.documents.select("doc_id", F.round(F.least(F.lit(1.0), tx.word_count(F.col("text")) / 450), 2).alias("confidence"))


@query("p2_extraction_quality", f"""SELECT doc_id, CASE WHEN n >= 150 THEN 'good' WHEN n >= 50 THEN 'partial' ELSE 'failed' END
  AS quality FROM (SELECT doc_id, {WORDS_SQL} AS n FROM documents)""")
def _(t):
    n = tx.word_count(F.col("text"))
    return t.documents.select("doc_id", F.when(n >= 150, "good").when(n >= 50, "partial").otherwise("failed").alias("quality"))


@query("p4_machine_readable", f"SELECT doc_id, {WORDS_SQL} >= 150 AS machine_readable FROM documents")
def _(t):
    return t.documents.select("doc_id", (tx.word_count(F.col("text")) >= 150).alias("machine_readable"))


_FREQ_TERMS = [s for v in FREQUENT.values() for s in v]
_DOUBLED = rf"regexp_replace(lower(text), '({W})', '\1\1', 'g')"


@query("a2_keyword_density", f"""WITH {lexicon_sql(FREQUENT)}, {marked_sql('doc_id', 'documents')},
  h AS (SELECT doc_id, {WORDS_SQL} AS words, (length(m) - length(replace(m, form, ''))) / length(form) AS c FROM mk, lex)
  SELECT doc_id, words, CAST(sum(c) AS BIGINT) AS occurrences,
    round(CASE WHEN words > 0 THEN sum(c) / words ELSE 0 END, 6) AS density FROM h GROUP BY doc_id, words""")
def _(t):
    return kw.keyword_density(t.documents, "text", _FREQ_TERMS).select(
        "doc_id", "words", "occurrences", F.round("density", 6).alias("density"))


@query("j1_lexicon_match", f"WITH {LEX_SQL} SELECT doc_id, category, skill FROM mk, lex WHERE {HIT}", uses=("cv_text",))
def _(t):
    lex = kw.lexicon_frame(t.spark, lx.SKILLS)
    return kw.lexicon_matches(t.cv_text, "doc_id", "text", lex).select("doc_id", "category", "skill")


@query("j1_lexicon_match_by_join", f"WITH {LEX_SQL} SELECT doc_id, category, skill FROM mk, lex WHERE {HIT}", uses=("cv_text",))
def _(t):
    lex = kw.lexicon_frame(t.spark, lx.SKILLS)
    return kw.lexicon_matches_by_join(t.cv_text, "doc_id", "text", lex).select("doc_id", "category", "skill")


@query("j1_lexicon_match_in_row", f"""WITH {LEX_SQL} SELECT doc_id, category, string_agg(skill, '|' ORDER BY ord) AS skills
  FROM mk, lex WHERE {HIT} GROUP BY doc_id, category""", uses=("cv_text",))
def _(t):
    df = with_grams(t.cv_text.select("doc_id", "text"), F.col("text"), "g", all_skills(lx.SKILLS))
    return (df.select("doc_id", F.explode(skills_by_category(F.col("g"), lx.SKILLS)).alias("category", "s"))
            .filter(F.size("s") > 0).select("doc_id", "category", F.array_join("s", "|").alias("skills")))


@query("j1_frequent_words", f"""WITH {lexicon_sql(FREQUENT)}, {marked_sql('doc_id', 'documents')}
  SELECT doc_id, category, skill FROM mk, lex WHERE contains(m, form)""")
def _(t):
    lex = kw.lexicon_frame(t.spark, FREQUENT)
    return kw.lexicon_matches(t.documents, "doc_id", "text", lex).select(
        "doc_id", "category", "skill")


@query("j2_tech_terms", f"""WITH {LEX_SQL} SELECT doc_id, string_agg(skill, ',' ORDER BY ord) AS stack
  FROM mk, lex WHERE {HIT} GROUP BY doc_id""", uses=("cv_text",))
def _(t):
    names = all_skills(lx.SKILLS)
    df = with_grams(t.cv_text.select("doc_id", "text"), F.col("text"), "g", names)
    return (df.select("doc_id", F.array_join(F.array_intersect(tx.lit_array(names), F.col("g")), ",").alias("stack"))
            .filter("stack <> ''"))


_CATS = lx.SKILL_FLAT_ORDER
_COUNTS = ", ".join(f"count(*) FILTER (WHERE category = '{c}') AS n_{c}" for c in _CATS)


@query("a3_skill_counts", f"WITH {LEX_SQL} SELECT doc_id, {_COUNTS}, count(*) AS total FROM mk, lex WHERE {HIT} GROUP BY doc_id",
       uses=("cv_text",))
def _(t):
    lex = kw.lexicon_frame(t.spark, lx.SKILLS)
    hits = kw.lexicon_matches(t.cv_text, "doc_id", "text", lex)
    return hits.groupBy("doc_id").agg(*[F.count_if(F.col("category") == c).alias(f"n_{c}") for c in _CATS],
                                      F.count("*").alias("total"))


@query("a22_skill_density_card", f"""WITH {LEX_SQL}, h AS (SELECT doc_id, count(*) AS n FROM mk, lex WHERE {HIT} GROUP BY doc_id)
  SELECT c.doc_id, CAST(round(coalesce(n, 0) / greatest({WORDS_SQL}, 1) * 100) AS BIGINT) AS density_pct
  FROM cv_text c LEFT JOIN h ON h.doc_id = c.doc_id""", uses=("cv_text",))
def _(t):
    names = all_skills(lx.SKILLS)
    df = with_grams(t.cv_text.select("doc_id", "text"), F.col("text"), "g", names)
    n = F.size(F.array_distinct("g"))
    return df.select("doc_id", F.round(n / F.greatest(tx.word_count(F.col("text")), F.lit(1)) * 100).cast("bigint").alias("density_pct"))


@query("t1_jd_keywords_top40", "WITH " + ranked_sql("item_id", jd_tokens_sql("item_id", "text", "benchmark"), 40))
def _(t):
    return kw.top_keyword_rows(t.benchmark, "item_id", "text", 40)


@query("t1_document_keywords_top40", "WITH " + ranked_sql("doc_id", jd_tokens_sql("doc_id", "text", "documents"), 40))
def _(t):
    return kw.top_keyword_rows(t.documents, "doc_id", "text", 40)


@query("udf3_own_tokens", rf"""WITH tok AS (SELECT doc_id, substr(w, 1, 5) AS w, pos FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
     FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS ws FROM documents)) WHERE length(w) > 2 AND w NOT IN ({STOPS})),
   cnt AS (SELECT doc_id, w, count(*) AS n, min(pos) AS p FROM tok GROUP BY doc_id, w),
   rk AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) AS rank FROM cnt)
   SELECT doc_id, string_agg(w, ',' ORDER BY rank) AS keywords FROM rk WHERE rank <= 20 GROUP BY doc_id""")
def _(t):
    stems = F.transform(tx.content_tokens(F.col("text")), lambda w: F.substring(w, 1, 5))  # in place of the caller's own lemmas
    found = kw.with_top_keywords(t.documents.select("doc_id", "text"), "text", "keywords", 20, tokens=stems)
    return found.filter(F.size("keywords") > 0).select("doc_id", F.array_join("keywords", ",").alias("keywords"))


@query("t2_content_keywords_top50", "WITH " + ranked_sql("doc_id", r"""SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{L}+') AS ws FROM documents)""", 50))
def _(t):
    return kw.top_keyword_rows(t.documents, "doc_id", "text", 50, content=True)


_PAIRS = f"""pr AS (SELECT u.conv_id, u.turn, u.text AS jd, lower(a.text) AS cv FROM conversations u JOIN conversations a
     ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
  tk AS (SELECT conv_id, turn, lower(unnest(ws)) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT conv_id, turn,
     regexp_extract_all({FOLD.format('jd')}, '\\b[a-zA-Z][a-zA-Z0-9+#.]+\\b') AS ws FROM pr)),
  ct AS (SELECT conv_id, turn, w, count(*) AS n, min(pos) AS p FROM tk WHERE length(w) > 2 AND w NOT IN ({STOPS}) GROUP BY ALL),
  rk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, p) AS r FROM ct),
  kx AS (SELECT rk.conv_id, rk.turn, w, r, contains(cv, w) AS hit FROM rk JOIN pr ON pr.conv_id = rk.conv_id AND pr.turn = rk.turn WHERE r <= 40)"""


def _turn_pairs(t):
    c = t.conversations
    u = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("jd"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.lower("text").alias("cv"))
    return kw.with_top_keywords(u, "jd", "k", 40).join(a, ["conv_id", "turn"])


@query("a6_keyword_match_ratio", f"""WITH {_PAIRS} SELECT pr.conv_id, pr.turn,
   round(coalesce(avg(CASE WHEN hit THEN 1.0 WHEN NOT hit THEN 0.0 END), 0.5), 6) AS keyword_match
   FROM pr LEFT JOIN kx ON kx.conv_id = pr.conv_id AND kx.turn = pr.turn GROUP BY pr.conv_id, pr.turn""")
def _(t):
    return _turn_pairs(t).select("conv_id", "turn", F.round(kw.match_ratio(F.col("k"), F.col("cv")), 6).alias("keyword_match"))


@query("t3_matched_missing", f"""WITH {_PAIRS},
   m AS (SELECT conv_id, turn, hit, w, r, row_number() OVER (PARTITION BY conv_id, turn, hit ORDER BY r) AS i FROM kx)
   SELECT pr.conv_id, pr.turn, coalesce(string_agg(w, ',' ORDER BY r) FILTER (WHERE hit AND i <= 20), '') AS matched,
     coalesce(string_agg(w, ',' ORDER BY r) FILTER (WHERE NOT hit AND i <= 20), '') AS missing
   FROM pr LEFT JOIN m ON m.conv_id = pr.conv_id AND m.turn = pr.turn GROUP BY pr.conv_id, pr.turn""")
def _(t):
    return _turn_pairs(t).select(
        "conv_id", "turn", F.array_join(F.slice(kw.matched(F.col("k"), F.col("cv")), 1, 20), ",").alias("matched"),
        F.array_join(F.slice(kw.missing(F.col("k"), F.col("cv")), 1, 20), ",").alias("missing"))


@query("a7_overall_score", f"""WITH {_PAIRS}, km AS (SELECT pr.conv_id, pr.turn,
   coalesce(avg(CASE WHEN hit THEN 1.0 WHEN NOT hit THEN 0.0 END), 0.5) AS k
   FROM pr LEFT JOIN kx ON kx.conv_id = pr.conv_id AND kx.turn = pr.turn GROUP BY pr.conv_id, pr.turn)
   SELECT conv_id, turn, round(0.5 * 35 + k * 40 + 0.75 * 25, 1) AS overall FROM km""")
def _(t):
    return _turn_pairs(t).select("conv_id", "turn", kw.overall_score(
        F.lit(0.5), kw.match_ratio(F.col("k"), F.col("cv")), F.lit(0.75)).alias("overall"))


@query("e1_email", rf"SELECT doc_id, nullif(regexp_extract(text, '{contact.EMAIL}'), '') AS email FROM documents")
def _(t):
    return t.documents.select("doc_id", contact.email(F.col("text")).alias("email"))


@query("e2_phone", rf"SELECT doc_id, nullif(regexp_extract(text, '{contact.PHONE}'), '') AS phone FROM documents")
def _(t):
    return t.documents.select("doc_id", contact.phone(F.col("text")).alias("phone"))


@query("e3_links", "SELECT doc_id, github, linkedin, CASE WHEN n_proj >= 1 THEN p1_url END AS url FROM cv_flat", uses=("cv_flat",))
def _(t):
    c = F.col("text")
    return t.cv_text.select("doc_id", contact.github(c).alias("github"), contact.linkedin(c).alias("linkedin"),
                            contact.url(c).alias("url"))


@query("e15_clean_text", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'),
   '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM documents""")
def _(t):
    return t.documents.select("doc_id", tx.clean_blanks(F.col("text")).alias("cleaned"))


_SORTED = sorted(set(all_skills(lx.SKILLS)))



def _dbl(s):
    return "".join(ch if ch.isalnum() or ch == "_" else ch + ch for ch in s)


_ALT_DBL = "|".join("".join("\\" + ch if ch in ".+*?/#" and ch in ".+*?" else ch for ch in _dbl(s)) for s in _SORTED)


@query("e22_alternation_skills", rf"""WITH m AS (SELECT doc_id, unnest(regexp_extract_all({_DOUBLED},
    '(^|{W})({_ALT_DBL})($|{W})', 2)) AS dbl FROM cv_text),
  u AS (SELECT DISTINCT doc_id, skill FROM m JOIN {sql_values([(s, _dbl(s)) for s in _SORTED], 'skill, form')} ON form = dbl)
  SELECT c.doc_id, coalesce(string_agg(skill, ',' ORDER BY skill), '') AS skills FROM cv_text c LEFT JOIN u ON u.doc_id = c.doc_id
  GROUP BY c.doc_id""", uses=("cv_text",))
def _(t):
    return t.cv_text.select("doc_id", F.array_join(alternation_skills(F.col("text"), lx.SKILLS), ",").alias("skills"))


_ACTIONS = ", ".join("'" + w.replace("'", "''") + "'" for w in lx.action_words())


@query("p12_action_signal", rf"""SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'),
   lambda x: x IN ({_ACTIONS}))) > 0 AS has_action FROM cv_text""", uses=("cv_text",))
def _(t):
    return t.cv_text.select("doc_id", tx.has_action_word(F.col("text")).alias("has_action"))


@query("s1_text_lines", r"""WITH x AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'),
   '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS ls FROM documents)
   SELECT doc_id, unnest(ls) AS text, generate_subscripts(ls, 1) - 1 AS line_no, 12.0::DOUBLE AS max_size,
     (generate_subscripts(ls, 1) - 1) * 15.0::DOUBLE AS top FROM x""")
def _(t):
    from sparkfolio.sources.text import line_table
    return line_table(t.documents, "doc_id", "text").select("doc_id", "text", "line_no", "max_size", "top")


@query("a1_words_by_language", f"""SELECT lang, count(*) AS docs, CAST(sum(n) AS BIGINT) AS words, max(n) AS longest
  FROM (SELECT lang, {WORDS_SQL} AS n FROM documents) GROUP BY lang""")
def _(t):
    return t.documents.select("lang", tx.word_count(F.col("text")).alias("n")).groupBy("lang").agg(
        F.count("*").alias("docs"), F.sum("n").alias("words"), F.max("n").alias("longest"))

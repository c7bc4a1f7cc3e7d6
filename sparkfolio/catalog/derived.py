"""Record tables that Spark derives from the given tables.

The given documents are prose, not records with dates and contacts.  The statements below use
each document row (its keys, its whole text) to state one record in flat columns, ``cv_flat``,
and render it as text, ``cv_text``.  Parsing ``cv_text`` must give back ``cv_flat``.  The SQL is
plain enough to mean the same in Spark and in the engine that checks the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AS_OF = (2026, 1)


def pick(words: str, key: str) -> str:
    n = words.count(",") + 1
    return f"split_part('{words}', ',', CAST(1 + ({key}) % {n} AS INT))"


_NOUNS = "Gear,Gizmo,Anvil,Ring,Bolt,Widget,Plate,Rod"
_ROLES = "engineer,analyst,technician,manager,consultant,developer"
_COMPANIES = "Novalis,Brickworks,Orion Labs,Maison Verte,Helios"
_CITIES = "Croix,Lyon,Saint-Étienne,Aix-En-Provence,Nantes,Lille,Paris"
_CODES = "59170,69001,42000,13100,44000,59000,75001"

_CV_FLAT = f"""
SELECT doc_id, text AS body, lang, source, n_chars,
  {pick('Alice,Bruno,Chloé,David,Emma,Farid,Gaelle,Hugo,Ines,Jules', 'doc_id')} || ' ' ||
  {pick('Martin,Bernard,Dubois,Lefèvre,Moreau,Garnier,Roussel', 'n_chars')} AS name,
  CASE WHEN doc_id % 7 = 0 THEN NULL ELSE
    CASE WHEN doc_id % 3 = 0 THEN 'Senior ' ELSE '' END ||
    {pick(_NOUNS, 'n_chars')} || ' ' || {pick(_ROLES, 'doc_id')} END AS title,
  CASE WHEN n_chars % 5 = 0 THEN NULL ELSE 'user' || CAST(doc_id AS STRING) || '@mail.example.org' END AS email,
  CASE WHEN n_chars % 3 = 0 THEN NULL ELSE '06 12 ' || lpad(CAST(doc_id % 100 AS STRING), 2, '0') || ' '
    || lpad(CAST(n_chars % 100 AS STRING), 2, '0') || ' 78' END AS phone,
  {pick(_CITIES, 'doc_id')} AS city, {pick(_CODES, 'doc_id')} AS postal,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE 'github.com/user' || CAST(doc_id AS STRING) END AS github,
  CASE WHEN n_chars % 4 = 0 THEN NULL ELSE 'linkedin.com/in/user-' || CAST(doc_id AS STRING) END AS linkedin,
  CASE WHEN n_chars % 4 = 1 THEN NULL ELSE 'Profil polyvalent, ' || lower({pick(_NOUNS, 'n_chars')}) || ' et '
    || {pick('industrie,vente,logistique,banque', 'doc_id')} || ', disponible de suite pour une mission longue' END AS summary,
  CAST(n_chars % 4 AS INT) AS n_exp, CAST(doc_id % 3 AS INT) AS n_edu,
  CAST((doc_id + n_chars) % 3 AS INT) AS n_proj, CAST(n_chars % 3 AS INT) AS n_lang,
  CAST(n_chars % 13 AS INT) AS n_skill,
  CASE WHEN n_chars % 6 = 0 THEN 'two_columns' ELSE 'single_column' END AS layout,
  CASE WHEN doc_id % 5 = 0 THEN 'ocr' ELSE 'pdfplumber' END AS method,
  {pick(_NOUNS, 'n_chars')} || ' ' || {pick(_ROLES, 'doc_id')} AS e1_title,
  {pick(_COMPANIES, 'doc_id')} AS e1_company,
  CAST(2015 + doc_id % 9 AS INT) AS e1_sy, CAST(1 + n_chars % 12 AS INT) AS e1_sm,
  {pick('Data analyst,Chef de projet,Conducteur de ligne,Agent de production', 'n_chars')} AS e2_title,
  {pick(_COMPANIES, 'n_chars')} AS e2_company,
  CAST(2015 + doc_id % 9 - n_chars % 3 - 2 - doc_id % 4 AS INT) AS e2_sy, CAST(1 + doc_id % 12 AS INT) AS e2_sm,
  CAST(2015 + doc_id % 9 - n_chars % 3 AS INT) AS e2_ey, CAST(1 + (doc_id + n_chars) % 12 AS INT) AS e2_em,
  CASE WHEN n_chars % 2 = 0 THEN 'Reduced costs by 20% in the usine' ELSE 'Worked with the magasin team' END AS e2_bullet,
  {pick('Technicien support,Vendeur,Magasinier', 'doc_id')} AS e3_title,
  {pick(_COMPANIES, 'doc_id + n_chars')} AS e3_company,
  CAST(2015 + doc_id % 9 - n_chars % 3 - 6 - doc_id % 5 AS INT) AS e3_sy,
  CAST(2015 + doc_id % 9 - n_chars % 3 - 5 - doc_id % 5 + n_chars % 2 AS INT) AS e3_ey,
  'Ingénieur ' || {pick('mécanique,logiciel,textile', 'n_chars')} AS d1_degree,
  {pick('Ecole Centrale,INSA Lyon,Université de Lille', 'doc_id')} AS d1_school,
  CAST(2000 + doc_id % 5 AS INT) AS d1_sy, CAST(2003 + doc_id % 5 AS INT) AS d1_ey,
  'Licence ' || {pick('maths,droit', 'n_chars')} AS d2_school,
  CAST(1997 + doc_id % 5 AS INT) AS d2_sy, CAST(2000 + doc_id % 5 AS INT) AS d2_ey,
  {pick(_NOUNS, 'doc_id')} || ' planner' AS p1_name,
  'tool written in ' || {pick('python,scala,rust,java', 'doc_id')} || ' with docker' AS p1_desc,
  'https://proj.example.org/' || CAST(doc_id AS STRING) AS p1_url,
  '+ gain ' || CAST(10 + n_chars % 80 AS STRING) || ' %' AS p1_metric,
  'Catalogue ' || lower({pick(_NOUNS, 'n_chars')}) AS p2_name,
  'site vitrine en php' AS p2_desc
FROM {{documents}}
"""

_MONTHS = "Jan,Feb,Mar,Apr,May,Jun,Jul,Aug,Sep,Oct,Nov,Dec"
_ALL_SKILLS = ("python,docker,aws,sql,kafka,spark,machine learning,react,git,power bi,terraform,"
               "crm,scikit-learn")


def _month(col: str) -> str:
    return f"split_part('{_MONTHS}', ',', {col})"


def _take(words: str, n: str, sep: str) -> str:
    """First n words of a list, joined; null when n is 0."""
    parts = words.split(",")
    whens = " ".join(f"WHEN {n} = {k} THEN '{sep.join(parts[:k])}'" for k in range(1, len(parts) + 1))
    return f"CASE {whens} END"


_NL = "chr(10)"
_CV_TEXT = f"""
SELECT *, concat_ws({_NL},
  name,
  title || ' | ' || e1_company,
  email, phone,
  replace(CASE WHEN doc_id % 2 = 0 THEN postal || ' ' || city ELSE city || ', ' || postal END, '-En-', '-en-'),
  github, linkedin,
  '' ,
  'SUMMARY' || {_NL} || summary,
  CASE WHEN n_exp >= 1 THEN concat_ws({_NL}, 'PROFESSIONAL EXPERIENCE',
     {_month('e1_sm')} || ' ' || CAST(e1_sy AS STRING) || ' – Present', e1_title || ' | ' || e1_company,
     '- ' || replace(body, {_NL}, {_NL} || '- ')) END,
  CASE WHEN n_exp >= 2 THEN concat_ws({_NL},
     {_month('e2_sm')} || ' ' || CAST(e2_sy AS STRING) || ' - ' || {_month('e2_em')} || ' ' || CAST(e2_ey AS STRING),
     e2_title || ' - ' || e2_company,
     '• ' || e2_bullet) END,
  CASE WHEN n_exp >= 3 THEN concat_ws({_NL},
     CAST(e3_sy AS STRING) || ' - ' || CAST(e3_ey AS STRING), e3_title || ' | ' || e3_company) END,
  CASE WHEN n_edu >= 1 THEN concat_ws({_NL}, '', 'EDUCATION',
     CAST(d1_sy AS STRING) || ' - ' || CAST(d1_ey AS STRING), d1_degree || ' | ' || d1_school, '- Mémoire sur hadoop') END,
  CASE WHEN n_edu >= 2 THEN concat_ws({_NL},
     CAST(d2_sy AS STRING) || ' - ' || CAST(d2_ey AS STRING), d2_school) END,
  'SKILLS' || {_NL} || {_take(_ALL_SKILLS, 'n_skill', ', ')},
  CASE WHEN n_proj >= 1 THEN concat_ws({_NL}, 'PROJECTS', p1_name, '- ' || p1_desc, p1_url, p1_metric) END,
  CASE WHEN n_proj >= 2 THEN concat_ws({_NL}, '', p2_name, '- ' || p2_desc) END,
  CASE WHEN n_lang >= 1 THEN concat_ws({_NL}, 'LANGUAGES', '- Français') END,
  CASE WHEN n_lang >= 2 THEN '• Anglais' END) AS text
FROM {{cv_flat}}
"""

# Listings stated from part rows: title, company, place, description, pay, source, url.
_LISTING = f"""
SELECT p_partkey AS listing_id,
  upper(substr(split_part(p_name, ' ', 2), 1, 1)) || substr(split_part(p_name, ' ', 2), 2) || ' ' ||
  CASE p_type WHEN 'ECONOMY' THEN 'engineer' WHEN 'SMALL' THEN 'analyst' WHEN 'MEDIUM' THEN 'technician'
    WHEN 'PROMO' THEN 'manager' WHEN 'STANDARD' THEN 'consultant' ELSE 'developer' END AS title,
  p_brand AS company,
  {pick(_CODES, 'p_size')} || ' ' || {pick(_CITIES, 'p_size')} AS location,
  'We look for a ' || p_name || ' profile, skills ' ||
    {pick('python,docker,aws,sql,kafka,spark,react,git', 'p_size')} || ' and ' ||
    {pick('terraform,crm,pandas,linux,scala', 'p_partkey')} || ' for the ' || lower(p_type) || ' team of ' || p_brand AS description,
  'https://jobs.example.org/' || split_part(p_name, ' ', 1) || '/' || CAST(p_partkey % 1000 AS STRING) AS url,
  CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 0.0 ELSE p_retailprice END AS salary_min,
  CASE WHEN p_size % 3 = 0 THEN p_retailprice + 100 END AS salary_max,
  CASE WHEN p_size % 2 = 0 THEN 'permanent' END AS contract_type,
  CASE p_size % 3 WHEN 0 THEN 'adzuna' WHEN 1 THEN 'jooble' ELSE 'france_travail' END AS source
FROM {{part}}
"""

SQL: dict[str, tuple[str, tuple[str, ...]]] = {
    "cv_flat": (_CV_FLAT.replace("{{", "{").replace("}}", "}"), ("documents",)),
    "cv_text": (_CV_TEXT.replace("{{", "{").replace("}}", "}"), ("cv_flat",)),
    "listing": (_LISTING.replace("{{", "{").replace("}}", "}"), ("part",)),
}


def _skills_map(n):
    by_cat = {"ml": [7, 13], "mlops": [2, 11], "cloud": [3], "languages": [1, 4],
              "data": [5, 6, 10], "other": [8, 9], "commerce": [12]}
    words = _ALL_SKILLS.split(",")
    pairs = []
    for cat, ranks in by_cat.items():
        pairs += [F.lit(cat), F.filter(F.array(*[F.when(n >= r, words[r - 1]) for r in ranks]),
                                       lambda x: x.isNotNull())]
    return F.create_map(*pairs)


def _cv(t) -> DataFrame:
    """``cv_flat`` as nested records (the schema of ``sparkfolio.schemas.CV``)."""
    from sparkfolio.functions.text import clean_blanks, drop_bullet, one_blank, strip, word_count
    from sparkfolio.functions.arrays import sealed
    from sparkfolio.operators.records import cv_record

    stated = t.cv_text
    flat = sealed(stated.withColumn("text", clean_blanks(F.col("text"))))  # cleaned once, not in each column that reads it
    flat = sealed(flat.withColumn("_words", word_count(F.col("text"))))
    ym = lambda y, m: F.format_string("%d-%02d", F.col(y), F.col(m))
    mon = lambda c: F.split_part(F.lit(_MONTHS), F.lit(","), F.col(c))
    lines = F.transform(F.split(one_blank(F.col("body")), "\n"),
                        lambda x: drop_bullet(F.concat(F.lit("- "), strip(x))))

    def exp(i, start, end, months, current, period, bullets):
        return F.when(F.col("n_exp") >= i, F.struct(
            F.col(f"e{i}_title").alias("title"), F.col(f"e{i}_company").alias("company"),
            period.alias("period"), start.alias("date_start"), end.alias("date_end"),
            months.cast("int").alias("duration_months"), F.lit(current).alias("is_current"),
            F.round(months / 12, 1).alias("years"), bullets.alias("bullets")))

    e1m = (AS_OF[0] - F.col("e1_sy")) * 12 + AS_OF[1] - F.col("e1_sm")
    e2m = (F.col("e2_ey") - F.col("e2_sy")) * 12 + F.col("e2_em") - F.col("e2_sm")
    e3m = (F.col("e3_ey") - F.col("e3_sy")) * 12
    s = lambda c: F.col(c).cast("string")
    experience = F.filter(F.array(
        exp(1, ym("e1_sy", "e1_sm"), F.lit("present"), e1m, True,
            F.concat(mon("e1_sm"), F.lit(" "), s("e1_sy"), F.lit(" – Present")), lines),
        exp(2, ym("e2_sy", "e2_sm"), ym("e2_ey", "e2_em"), e2m, False,
            F.concat(mon("e2_sm"), F.lit(" "), s("e2_sy"), F.lit(" - "), mon("e2_em"), F.lit(" "), s("e2_ey")),
            F.array("e2_bullet")),
        exp(3, s("e3_sy"), s("e3_ey"), e3m, False, F.concat(s("e3_sy"), F.lit(" - "), s("e3_ey")),
            F.array().cast("array<string>"))), lambda x: x.isNotNull())

    def edu(i, degree, school, skills):
        return F.when(F.col("n_edu") >= i, F.struct(
            degree.alias("degree"), school.alias("school"),
            F.concat(s(f"d{i}_sy"), F.lit(" - "), s(f"d{i}_ey")).alias("year"),
            s(f"d{i}_sy").alias("date_start"), s(f"d{i}_ey").alias("date_end"),
            ((F.col(f"d{i}_ey") - F.col(f"d{i}_sy")) * 12).cast("int").alias("duration_months"),
            F.lit(False).alias("is_current"), skills.alias("skills")))

    education = F.filter(F.array(
        edu(1, F.col("d1_degree"), F.col("d1_school"), F.array(F.lit("hadoop"))),
        edu(2, F.lit(""), F.col("d2_school"), F.array().cast("array<string>"))), lambda x: x.isNotNull())

    def project(i, url, stack, metrics):
        return F.when(F.col("n_proj") >= i, F.struct(
            F.col(f"p{i}_name").alias("name"), F.col(f"p{i}_desc").alias("description"),
            stack.alias("stack"), url.alias("url"), metrics.alias("metrics")))

    lang_name = F.split_part(F.lit("python,scala,rust,java"), F.lit(","), (1 + F.col("doc_id") % 4).cast("int"))
    projects = F.filter(F.array(
        project(1, F.col("p1_url"), F.array(F.lit("docker"), lang_name), F.array("p1_metric")),
        project(2, F.lit(None).cast("string"), F.array(F.lit("php")), F.array().cast("array<string>"))),
        lambda x: x.isNotNull())
    languages = F.filter(F.array(F.when(F.col("n_lang") >= 1, "Français"), F.when(F.col("n_lang") >= 2, "Anglais")),
                         lambda x: x.isNotNull())
    raw = F.col("text")
    return cv_record(
        flat, doc_id=F.col("doc_id"),
        header=F.struct("name", "title", "email", "phone", F.col("city").alias("location"),
                        F.col("postal").alias("postal_code"), "github", "linkedin"),
        summary=F.col("summary"), skills=_skills_map(F.col("n_skill")), experience=experience,
        education=education, projects=projects, languages=languages, raw_text=raw,
        layout_detected=F.col("layout"), word_count=F.col("_words"), extraction_method=F.col("method"),
        extraction_confidence=F.round(F.least(F.lit(1.0), F.col("_words") / 450), 2))


FRAMES = {"cv": _cv}

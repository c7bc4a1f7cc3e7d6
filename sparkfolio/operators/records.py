"""From lines of text to one nested record, inside the row.

A document's lines are an array column; sections, entries, projects and contacts are cut from it
with array expressions, so parsing needs no shuffle and no Python.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import contact, dates
from sparkfolio.functions import text as tx
from sparkfolio.functions.arrays import cut_at, int_range, let, sealed
from sparkfolio.functions.skills import all_skills, alternation_skills, flat_skills, grams_in, skills_by_category
from sparkfolio.operators.keywords import with_top_keywords

LINE = "struct<text:string,size:double,bold:boolean,x0:double,top:double,col:string>"
_STRS = "array<string>"


def text_lines(text: Column) -> Column:
    """Lines of a plain text as array<struct<text,size,bold,x0,top,col>> (uniform typography)."""
    flat = F.regexp_replace(tx.one_blank(text), r"\n{3,}", "\n\n")
    return F.transform(F.split(flat, "\n"), lambda t, i: F.struct(
        t.alias("text"), F.lit(12.0).alias("size"), F.lit(False).alias("bold"), F.lit(0.0).alias("x0"),
        (i * 15).cast("double").alias("top"), F.lit("full").alias("col")))


def join_lines(lines: Column) -> Column:
    """Text of a line array: blanks collapsed, at most one empty line in a row, outer space off."""
    return tx.clean_blanks(F.array_join(F.transform(lines, lambda x: x["text"]), "\n"))


def common_size(lines: Column, default: float = 10.0) -> Column:
    """Most frequent line size rounded to 0.1, first seen on ties."""
    sizes = F.transform(F.filter(lines, lambda x: (tx.strip(x["text"]) != "") & (x["size"] > 0)),
                        lambda x: F.round(x["size"], 1))
    ranked = let(sizes, lambda s: F.sort_array(F.transform(F.array_distinct(s), lambda v, i: F.struct(
        (-F.size(F.filter(s, lambda y: y == v))).alias("neg"), i.alias("i"), v.alias("v")))))
    return F.coalesce(F.get(ranked, F.lit(0))["v"], F.lit(default))


# --- sections --------------------------------------------------------------------------------
def section_chunks(lines: Column, body_size: Column) -> Column:
    """array<struct<section,lines>>: every line belongs to the last section header above it."""
    def marked(ls):
        return let(F.transform(ls, lambda x: F.when(
            tx.is_header_line(x["text"], x["size"], x["bold"], body_size), tx.section_name(x["text"]))),
            lambda m: let(F.filter(int_range(F.lit(1), F.size(m)), lambda i: F.get(m, i - 1).isNotNull()),
                          lambda st: cut(ls, m, st)))

    def cut(ls, m, st):
        n = F.size(ls)
        head = F.struct(F.lit("header").alias("section"), F.slice(
            ls, F.lit(1), F.coalesce(F.get(st, F.lit(0)) - 1, n)).alias("lines"))
        rest = F.transform(st, lambda s, j: F.struct(
            F.get(m, s - 1).alias("section"),
            F.slice(ls, s + 1, F.coalesce(F.get(st, j + 1), n + 1) - s - 1).alias("lines")))
        return F.concat(F.array(head), rest)

    return let(lines, marked)


def section_lines(chunks: Column, name: str) -> Column:
    return F.flatten(F.transform(F.filter(chunks, lambda c: c["section"] == name), lambda c: c["lines"]))


def text_sections(text: Column) -> Column:
    """map section -> text for plain text (60-character headers); empty sections left out."""
    lines = F.transform(F.split(text, "\n"), tx.strip)

    def build(ls):
        marks = F.transform(ls, lambda t: F.when(tx.is_header_text(t), tx.section_name(t)))
        return let(F.struct(ls.alias("l"), marks.alias("m")), from_marks)

    def from_marks(s):
        starts = F.filter(int_range(F.lit(1), F.size(s["m"])), lambda i: F.get(s["m"], i - 1).isNotNull())
        return let(F.struct(s["l"].alias("l"), s["m"].alias("m"), starts.alias("s")), from_starts)

    def from_starts(s):
        n = F.size(s["l"])
        head = F.struct(F.lit("header").alias("k"),
                        F.slice(s["l"], F.lit(1), F.coalesce(F.get(s["s"], F.lit(0)) - 1, n)).alias("v"))
        rest = F.transform(s["s"], lambda b, j: F.struct(
            F.get(s["m"], b - 1).alias("k"),
            F.slice(s["l"], b + 1, F.coalesce(F.get(s["s"], j + 1), n + 1) - b - 1).alias("v")))
        return let(F.concat(F.array(head), rest), by_name)

    def by_name(chunks):
        names = F.array_distinct(F.transform(chunks, lambda c: c["k"]))
        entries = F.transform(names, lambda k: F.struct(k.alias("k"), tx.strip(F.array_join(F.flatten(
            F.transform(F.filter(chunks, lambda c: c["k"] == k), lambda c: c["v"])), "\n")).alias("v")))
        return F.map_from_entries(F.filter(entries, lambda e: e["v"] != ""))

    return let(lines, build)


# --- dated entries ---------------------------------------------------------------------------
def entry_groups(lines: Column) -> Column:
    """Lines of a section cut into entries: array<array<line>>.

    A short non-bullet date line opens an entry when the current one already has a date; a large
    bold line always opens one.  Written as positions instead of a running state: a date line
    opens an entry when the last dated line before it is not above the last bold opening.
    """
    def facts(ls):
        big = common_size(ls) * 1.2
        return let(big, lambda b: F.transform(ls, lambda x: let(tx.strip(x["text"]), lambda t: F.struct(
            x["text"].alias("text"), dates.contains_date(t).alias("dated"), tx.is_bullet(t).alias("bullet"),
            F.length(t).alias("n"), (x["bold"] & (x["size"] >= b)).alias("big")))))

    def cut(f):
        idx = int_range(F.lit(1), F.size(f))
        dated = F.filter(idx, lambda i: F.get(f, i - 1)["dated"])
        opens = F.filter(idx, lambda i: let(F.get(f, i - 1), lambda x: x["dated"] & ~x["bullet"] & (x["n"] < 100)))
        big = F.filter(idx, lambda i: let(F.get(f, i - 1), lambda x: x["big"] & ~x["bullet"] & (x["n"] < 80)
                       & ~(x["dated"] & (x["n"] < 100))))
        s = F.struct(f.alias("f"), dated.alias("d"), opens.alias("o"), big.alias("b"))
        return let(s, starts)

    def starts(s):
        by_date = F.filter(s["o"], lambda q: F.coalesce(
            F.array_max(F.filter(s["d"], lambda c: c < q)), F.lit(0)) >= F.coalesce(
            F.array_max(F.filter(s["b"], lambda b: b < q)), F.lit(1)))
        first = F.when(F.size(s["f"]) > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
        return cut_at(F.transform(s["f"], lambda x: x["text"]),
                      F.sort_array(F.array_distinct(F.concat(first, by_date, s["b"]))))

    return let(F.filter(lines, lambda x: tx.strip(x["text"]) != ""), lambda ls: let(facts(ls), cut))


def entry_record(group: Column, as_of: tuple[int, int]) -> Column:
    """One entry's texts as struct<title,company,period,...,bullets>."""
    def split_lines(g):
        f = F.transform(g, lambda t: F.struct(t.alias("t"), tx.is_bullet(t).alias("b"),
                                              (~tx.is_bullet(t) & dates.contains_date(t)).alias("d")))
        return let(f, by_kind)

    def by_kind(f):
        bullets = F.transform(F.filter(f, lambda x: x["b"]), lambda x: tx.drop_bullet(x["t"]))
        ranges = F.filter(F.transform(F.filter(f, lambda x: x["d"]), lambda x: F.struct(
            x["t"].alias("t"), dates.date_range(x["t"], as_of).alias("r"))),
            lambda x: x["r"]["date_start"].isNotNull() | (x["r"]["months"] > 0))
        plain = F.transform(F.filter(f, lambda x: ~x["b"] & ~x["d"]), lambda x: F.struct(
            x["t"].alias("t"), tx.has_title_word(x["t"]).alias("job")))
        return let(F.struct(bullets.alias("bullets"), F.get(ranges, F.size(ranges) - 1).alias("p"),
                            plain.alias("plain")), with_title)

    def with_title(s):
        at = F.get(F.filter(int_range(F.lit(1), F.size(s["plain"])),
                            lambda i: F.get(s["plain"], i - 1)["job"]), F.lit(0))
        parts = F.when(at.isNotNull(), tx.split_title(F.get(s["plain"], at - 1)["t"]))
        return let(F.struct(s["bullets"].alias("bullets"), s["p"].alias("p"), s["plain"].alias("plain"),
                            at.alias("at"), parts.alias("parts")), build)

    def build(s):
        n = F.size(s["plain"])
        before = F.filter(F.slice(s["plain"], F.lit(1), F.coalesce(s["at"] - 1, n)), lambda x: F.length(x["t"]) < 80)
        after = F.when(s["at"].isNotNull(), F.filter(
            F.slice(s["plain"], s["at"] + 1, n), lambda x: x["job"] | (F.length(x["t"]) < 80)))
        company = F.coalesce(F.when(F.size(s["parts"]) > 1, F.get(s["parts"], F.lit(1))),
                             F.get(before, F.lit(0))["t"], F.get(after, F.lit(0))["t"])
        r = s["p"]["r"]
        return F.struct(
            F.get(s["parts"], F.lit(0)).alias("title"), company.alias("company"),
            s["p"]["t"].alias("period"), r["date_start"].alias("date_start"), r["date_end"].alias("date_end"),
            r["months"].alias("duration_months"), F.coalesce(r["is_current"], F.lit(False)).alias("is_current"),
            F.when(r["months"] > 0, F.round(r["months"] / 12, 1)).alias("years"), s["bullets"].alias("bullets"))

    return let(F.transform(group, tx.strip), split_lines)


def by_recency(entries: Column) -> Column:
    """Most recent start first, month before year-only in the same year, undated last, stable."""
    keyed = F.transform(entries, lambda e, i: F.struct(
        F.coalesce(-F.get(F.split(e["date_start"], "-"), F.lit(0)).cast("int"), F.lit(0)).alias("y"),
        F.coalesce(-F.get(F.split(e["date_start"], "-"), F.lit(1)).cast("int"), F.lit(0)).alias("m"),
        i.alias("i"), e.alias("e")))
    return F.transform(F.sort_array(keyed), lambda k: k["e"])


def _present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def timed_entries(lines: Column, as_of: tuple[int, int]) -> Column:
    """All entries of a section, noise dropped, most recent first."""
    made = F.transform(entry_groups(lines), lambda g: F.struct(
        F.aggregate(g, F.lit(0), lambda acc, t: acc + tx.word_count(t)).alias("n"),
        entry_record(g, as_of).alias("e")))

    def keep(x):
        e = x["e"]
        noise = (x["n"] < 3) & e["date_start"].isNull() & ~F.coalesce(e["duration_months"] > 0, F.lit(False)) \
            & (F.size(e["bullets"]) == 0)
        filled = _present(e["title"]) | _present(e["company"]) | _present(e["period"]) | (F.size(e["bullets"]) > 0)
        return ~noise & filled

    return by_recency(F.transform(F.filter(made, keep), lambda x: x["e"]))


def education_entries(lines: Column, as_of: tuple[int, int], lexicon: dict[str, list[str]]) -> Column:
    """Education entries: title becomes degree, company becomes school; role labels are rejected."""
    terms = all_skills(lexicon)

    def convert(e):
        degree = F.coalesce(e["title"], F.lit(""))
        school = F.coalesce(e["company"], F.lit(""))
        school = F.when(F.rtrim(school).endswith(":"), F.lit("")).otherwise(school)
        undated = e["date_start"].isNull() & ~F.coalesce(e["duration_months"] > 0, F.lit(False))
        return F.struct(
            degree.alias("degree"), school.alias("school"), e["period"].alias("year"),
            e["date_start"].alias("date_start"), e["date_end"].alias("date_end"),
            e["duration_months"].alias("duration_months"), e["is_current"].alias("is_current"),
            F.array_intersect(tx.lit_array(terms), grams_in(F.array_join(e["bullets"], " "), terms)).alias("skills"),
            undated.alias("undated"), (F.size(e["bullets"]) == 0).alias("bare"))

    kept = F.filter(F.transform(timed_entries(lines, as_of), convert), lambda d: ~education_rejected(
        d["degree"], d["school"], d["undated"], d["bare"]))
    fields = ["degree", "school", "year", "date_start", "date_end", "duration_months", "is_current", "skills"]
    return F.transform(kept, lambda d: F.struct(*[d[f].alias(f) for f in fields]))


def education_rejected(degree: Column, school: Column, undated: Column, no_bullets: Column) -> Column:
    """Undated entries that are role labels, blank, or a bare job title."""
    label = F.rtrim(degree).endswith(":") | ((degree == "") & (school == ""))
    bare_title = tx.has_title_word(F.regexp_replace(degree, r":+$", "")) & no_bullets
    return undated & (label | bare_title)


# --- projects, languages, header -------------------------------------------------------------
def blank_chunks(texts: Column) -> Column:
    """Texts cut at blank ones: array<array<string>>, blanks dropped."""
    def cut(ls):
        blank = F.transform(ls, lambda t: tx.strip(t) == "")
        first = F.filter(int_range(F.lit(1), F.size(ls)), lambda i: ~F.get(blank, i - 1) & (
            (i == 1) | F.get(blank, i - 2)))
        return F.transform(cut_at(ls, first), lambda block: F.filter(block, lambda t: tx.strip(t) != ""))

    return let(texts, cut)


def project_entries(lines: Column, lexicon: dict[str, list[str]]) -> Column:
    """Blocks between blank lines as project records."""
    terms = all_skills(lexicon)

    def record(b):
        joined = F.array_join(b, " ")
        bullets = F.transform(F.filter(F.slice(b, 2, F.greatest(F.size(b), F.lit(1))), lambda t: t.rlike(tx.BULLET)),
                              tx.drop_bullet)
        # the digits of an address are no figure
        metrics = F.transform(F.filter(b, lambda t: tx.has_metric(F.regexp_replace(t, contact.URL, " "))), tx.strip)
        return let(bullets, lambda bl: F.struct(
            tx.strip(F.get(b, F.lit(0))).alias("name"),
            F.when(F.size(bl) > 0, F.array_join(bl, " ")).alias("description"),
            F.array_intersect(tx.lit_array(terms), grams_in(joined, terms)).alias("stack"),
            contact.url(joined).alias("url"), metrics.alias("metrics")))

    return F.transform(blank_chunks(F.transform(lines, lambda x: x["text"])), record)


def language_list(lines: Column) -> Column:
    cleaned = F.transform(lines, lambda x: tx.drop_bullet(x["text"]))
    return F.filter(cleaned, lambda t: (t != "") & (F.length(t) < 60))


def header_record(lines: Column, raw_text: Column) -> Column:
    """struct of contacts, name and title from the header lines; place also from the whole text."""
    def fields(ls):
        joined = F.array_join(F.transform(ls, lambda x: x["text"]), "\n")
        return let(F.struct(ls.alias("ls"), joined.alias("all"), name_line(ls).alias("nl")), build)

    def build(s):
        nl, ls = s["nl"], s["ls"]
        base = tx.strip(nl["text"])
        other = F.get(F.filter(ls, lambda x: (
            (x["col"] == F.when(nl["col"] == "left", "right").otherwise("left"))
            & (F.abs(x["top"] - nl["top"]) <= 15) & (tx.strip(x["text"]) != "")
            & ~contact.has_contact(x["text"]))), F.lit(0))
        joined = F.when(nl["col"].isin("left", "right") & other.isNotNull(), F.when(
            nl["col"] == "left", F.concat(base, F.lit(" "), tx.strip(other["text"]))).otherwise(
            F.concat(tx.strip(other["text"]), F.lit(" "), base))).otherwise(base)
        return let(F.struct(s["all"].alias("all"), ls.alias("ls"), joined.alias("name")), finish)

    def finish(s):
        titled = F.filter(F.transform(s["ls"], lambda x: tx.strip(x["text"])), lambda t: (
            (t != "") & (s["name"].isNull() | (t != s["name"])) & tx.has_title_word(t) & ~contact.has_contact(t)))
        titles = F.filter(F.transform(titled, tx.first_title_segment), lambda t: t.isNotNull())
        city = contact.city(s["all"])
        return F.struct(
            s["name"].alias("name"), F.get(titles, F.lit(0)).alias("title"),
            contact.email(s["all"]).alias("email"), contact.phone(s["all"]).alias("phone"),
            F.coalesce(city, contact.city(raw_text)).alias("location"),
            F.when(city.isNotNull(), contact.postal_code(s["all"])).otherwise(
                contact.postal_code(raw_text)).alias("postal_code"),
            contact.github(s["all"]).alias("github"), contact.linkedin(s["all"]).alias("linkedin"))

    return let(lines, fields)


def name_line(lines: Column) -> Column:
    """Largest line without email or phone, first on ties."""
    ranked = F.sort_array(F.transform(
        F.filter(lines, lambda x: (tx.strip(x["text"]) != "") & ~contact.has_contact(x["text"], links=False)),
        lambda x, i: F.struct((-x["size"]).alias("neg"), i.alias("i"), x.alias("x"))))
    return F.get(ranked, F.lit(0))["x"]


def summary_text(chunks: Column, positioned: bool) -> Column:
    """Summary section, else long header sentences without contacts."""
    def prose(x):
        t = x["text"]
        ok = (F.length(tx.strip(t)) > 60) & (tx.word_count(t) > 8) & ~contact.has_contact(t)
        if positioned:
            ok = ok & ~t.rlike(contact.URL) & ~t.rlike(contact.POSTAL_ANY)
        return ok

    own = F.nullif(join_lines(section_lines(chunks, "summary")), F.lit(""))
    return F.coalesce(own, F.nullif(join_lines(F.filter(section_lines(chunks, "header"), prose)), F.lit("")))


RECORD_FIELDS = ("raw_text", "header", "summary", "skills", "experience", "education", "projects", "languages",
                 "word_count")


def parse_lines(df: DataFrame, lines: str, body_size: Column, as_of: tuple[int, int], positioned: bool,
                lexicon: dict[str, list[str]] = lx.SKILLS, header_lines: str | None = None,
                fields: Sequence[str] = RECORD_FIELDS) -> DataFrame:
    """Add the asked record fields to a frame with a line-array column."""
    df = df.withColumn("_chunks", section_chunks(F.col(lines), body_size)).withColumn("raw_text", join_lines(F.col(lines)))

    def section(name):
        return section_lines(F.col("_chunks"), name)

    make = {
        "header": lambda: header_record(F.col(header_lines) if header_lines else section("header"), F.col("raw_text")),
        "summary": lambda: summary_text(F.col("_chunks"), positioned),
        "skills": lambda: let(grams_in(F.col("raw_text"), all_skills(lexicon)), lambda h: skills_by_category(h, lexicon)),
        "experience": lambda: timed_entries(section("experience"), as_of),
        "education": lambda: education_entries(section("education"), as_of, lexicon),
        "projects": lambda: project_entries(section("projects"), lexicon),
        "languages": lambda: language_list(section("languages")),
        "word_count": lambda: tx.word_count(F.col("raw_text")),
    }
    for f in fields:
        if f != "raw_text":
            df = df.withColumn(f, make[f]())
    return df.drop("_chunks")


def parse_text(df: DataFrame, text: str = "text", as_of: tuple[int, int] = (2026, 1), method: str = "ocr",
               lexicon: dict[str, list[str]] = lx.SKILLS, fields: Sequence[str] = RECORD_FIELDS) -> DataFrame:
    """Plain texts to records, one row in, one row out; only the asked fields are computed."""
    df = parse_lines(df.withColumn("_lines", text_lines(F.col(text))), "_lines", F.lit(12.0), as_of,
                     positioned=False, lexicon=lexicon, fields=fields)
    df = (df.drop("_lines").withColumn("layout_detected", F.lit("single_column"))
          .withColumn("extraction_method", F.lit(method)))
    if "word_count" in fields:
        df = df.withColumn("extraction_confidence", F.round(F.least(F.lit(1.0), F.col("word_count") / 450), 2))
    return sealed(df)


# --- whole records ---------------------------------------------------------------------------
def section_map(header: Column, summary: Column, experience: Column, education: Column, skills: Column,
                projects: Column, languages: Column) -> Column:
    """map section -> text rebuilt from the structured fields; empty sections left out."""
    def parts(*cols):
        return F.filter(F.array(*cols), _present)

    head = F.when(_present(header["name"]) | _present(header["title"]), F.array_join(parts(
        header["name"], header["title"], header["email"], header["phone"], header["location"]), "\n"))
    exp = F.when(F.size(experience) > 0, F.array_join(F.flatten(F.transform(experience, lambda e: F.concat(
        F.array(F.array_join(parts(e["title"], e["company"], e["period"]), " — ")), e["bullets"]))), "\n"))
    edu = F.when(F.size(education) > 0, F.array_join(F.transform(education, lambda e: tx.strip(F.concat_ws(
        " ", e["degree"], e["school"], F.coalesce(e["year"], F.lit(""))))), "\n"))
    flat = flat_skills(skills)
    entries = [("header", head), ("summary", F.nullif(summary, F.lit(""))), ("experience", exp), ("education", edu),
               ("skills", F.when(F.size(flat) > 0, F.array_join(flat, ", "))),
               ("projects", F.when(F.size(projects) > 0, F.array_join(F.transform(projects, lambda p: p["name"]), "\n"))),
               ("languages", F.when(F.size(languages) > 0, F.array_join(languages, ", ")))]
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), v.alias("v")) for k, v in entries])
    return F.map_from_entries(F.filter(pairs, lambda p: p["v"].isNotNull()))


def rebuilt_text(header: Column, summary: Column, skills: Column, experience: Column, education: Column,
                 projects: Column) -> Column:
    """One text from the structured fields, blanks left out."""
    parts = F.concat(
        F.array(header["name"], header["title"], header["location"], summary), flat_skills(skills),
        F.flatten(F.transform(experience, lambda e: F.concat(
            F.array(e["title"], e["company"], e["period"]), e["bullets"]))),
        F.flatten(F.transform(education, lambda e: F.concat(F.array(e["degree"], e["school"]), e["skills"]))),
        F.flatten(F.transform(projects, lambda p: F.concat(
            F.array(p["name"], p["description"]), p["stack"], p["metrics"]))))
    return F.array_join(F.filter(parts, lambda s: s.isNotNull() & (tx.strip(s) != "")), " ")


def richness(header: Column, summary: Column, skills: Column, experience: Column, education: Column,
             projects: Column) -> Column:
    """Structural richness; the commerce category does not count."""
    n_skills = F.size(flat_skills(skills, [c for c in lx.SKILL_FLAT_ORDER if c != "commerce"]))
    return (F.size(experience) * 10 + F.size(education) * 8 + n_skills * 2 + F.size(projects) * 10
            + F.when(_present(header["email"]), 15).otherwise(0) + F.when(_present(header["title"]), 15).otherwise(0)
            + F.when(_present(summary), 10).otherwise(0)).cast("double")


def sector_of(experience: Column, sectors: list[tuple[str, list[str]]] = tuple(lx.SECTOR_WORDS)) -> Column:
    """First sector, in declared order, with a word contained in titles, companies or bullets."""
    joined = F.lower(F.array_join(F.flatten(F.transform(experience, lambda e: F.concat(
        F.filter(F.array(e["title"], e["company"]), _present), e["bullets"]))), " "))
    return let(joined, lambda t: first_sector(t, sectors))


def first_sector(text_lower: Column, sectors=tuple(lx.SECTOR_WORDS)) -> Column:
    out = None
    for name, keywords in sectors:
        hit = F.lit(False)
        for k in keywords:
            hit = hit | F.contains(text_lower, F.lit(k))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def cv_record(df: DataFrame, **cols: Column) -> DataFrame:
    """Select the base record columns and add the fields that follow from them; skills stay as stated."""
    base = df.select(*[c.alias(n) for n, c in cols.items()])
    return enrich(base, text_skills=False)


def enrich(cv: DataFrame, current_year: int = 2026, entities: Column | None = None, text_skills: bool = True) -> DataFrame:
    """Add sections, skills_flat, experience_years, job_title, location, postal_code, sector, keywords.

    ``entities`` is an optional array<string> of place names found by the caller's own tagger.  A record without skills
    gets those that stand in its text, unless ``text_skills`` is off.
    """
    c = F.col
    places = entities if entities is not None else F.array().cast(_STRS)
    cv = sealed(cv.withColumn("raw_text", tx.clean_blanks(c("raw_text"))))  # several columns read it
    cv = cv.withColumn("sections", section_map(c("header"), c("summary"), c("experience"), c("education"),
                                               c("skills"), c("projects"), c("languages")))
    months = F.aggregate(c("experience"), F.lit(0), lambda a, e: a + F.coalesce(e["duration_months"], F.lit(0)))
    head = F.coalesce(F.try_element_at(c("sections"), F.lit("header")), F.lit(""))
    flat = flat_skills(c("skills"))
    if text_skills:
        flat = F.when(F.size(flat) > 0, flat).otherwise(F.coalesce(alternation_skills(c("raw_text"), lx.SKILLS), F.array().cast(_STRS)))
    cv = (cv.withColumn("skills_flat", flat)
          .withColumn("experience_years", F.when(months > 0, F.round(months / 12, 1)).otherwise(
              dates.years_from_spans(F.coalesce(F.try_element_at(c("sections"), F.lit("experience")), F.lit("")),
                                     current_year)))
          .withColumn("job_title", F.coalesce(
              F.nullif(c("header")["title"], F.lit("")), F.nullif(F.get("experience", F.lit(0))["title"], F.lit("")),
              tx.job_title_from(head))))
    place = contact.cascade_location(c("header")["location"], c("header")["postal_code"], c("raw_text"),
                                     c("job_title"), contact.entity_location(head, places))
    done = sealed(cv.withColumn("_place", place).withColumn("location", c("_place")["city"])
                  .withColumn("postal_code", c("_place")["code"]).withColumn("sector", sector_of(c("experience")))
                  .drop("_place"))
    return with_top_keywords(done, "raw_text", "keywords", 50, content=True)

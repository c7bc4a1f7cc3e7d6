"""Text expressions: cleaning, counting, tokens, n-grams, section headers.

All functions take and return Columns; nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions.arrays import let

WORD = r"[\p{L}\p{N}_]"


def lit_array(values: Sequence) -> Column:
    """Constant array; an empty list becomes an empty array<string>."""
    if not values:
        return F.array().cast("array<string>")
    return F.array(*[F.lit(v) for v in values])


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t\n\r\f\x0b"))


def _replaced(c: Column, marks: Sequence[str], pattern: str, by: str) -> Column:
    """``regexp_replace`` where one of ``marks`` stands, without which the pattern cannot match: a plain search costs far less."""
    def made(x):
        hit = F.lit(False)
        for m in marks:
            hit = hit | F.contains(x, F.lit(m))
        return F.when(hit, F.regexp_replace(x, pattern, by)).otherwise(x)

    return let(c, made)


def one_blank(c: Column) -> Column:
    """Runs of blanks and tabs to one blank. Single blanks are no match: most of them are, and each replacement costs."""
    return _replaced(c, ["  ", "\t"], r"\t[ \t]*+| [ \t]++", " ")


def clean_blanks(c: Column) -> Column:
    """Runs of blanks to one blank, three or more newlines to two, outer whitespace removed."""
    return strip(_replaced(one_blank(c), ["\n\n\n"], r"\n{3,}", "\n\n"))


def words(c: Column) -> Column:
    """Whitespace-separated words; a no-break space separates too."""
    return F.regexp_extract_all(F.replace(c, F.lit("\u00a0"), F.lit(" ")), F.lit(r"\S+"), F.lit(0))


def word_count(c: Column) -> Column:
    return F.coalesce(F.size(words(c)), F.lit(0))


def title_case(c: Column) -> Column:
    """Capitalise every run of letters (also after - and ')."""
    runs = F.regexp_extract_all(c, F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def guarded(term_regex: str) -> str:
    """Regex with letter/digit guards, valid for terms that start or end with a symbol."""
    return rf"(?<!{WORD})(?:{term_regex})(?!{WORD})"


def is_upper(c: Column) -> Column:
    return (F.upper(c) == c) & (F.lower(c) != c)


# --- tokens ----------------------------------------------------------------------------------
def keyword_tokens(c: Column, stop_words: Sequence[str] = tuple(lx.STOP_WORDS)) -> Column:
    """Lower-cased ASCII keyword tokens longer than two characters, stop words removed."""
    raw = F.regexp_extract_all(c, F.lit(r"(?U)\b[a-zA-Z][a-zA-Z0-9+#.]+\b"), F.lit(0))
    low = F.transform(raw, F.lower)
    return F.filter(low, lambda t: (F.length(t) > 2) & ~t.isin(*stop_words))


def content_tokens(c: Column, stop_words: Sequence[str] = tuple(lx.STOP_WORDS)) -> Column:
    """Lower-cased letter tokens (any script) longer than two characters, stop words removed."""
    raw = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+"), F.lit(0))
    return F.filter(raw, lambda t: (F.length(t) > 2) & ~t.isin(*stop_words))


def text_parts(c: Column) -> Column:
    """Lower-cased text cut into alternating word and separator runs."""
    return F.regexp_extract_all(F.lower(c), F.lit(rf"{WORD}+|[^\p{{L}}\p{{N}}_]+"), F.lit(0))


def word_grams(parts: Column, max_words: int = 0, lengths: Sequence[int] = ()) -> Column:
    """All 1..max_words word n-grams of ``text_parts`` output (or those of the given ``lengths``), separators kept as written."""
    def grams(p):
        n = F.size(p)
        first = F.when(F.get(p, F.lit(0)).rlike(f"^{WORD}"), 1).otherwise(2)
        starts = F.when(n >= first, F.sequence(first, n, F.lit(2))).otherwise(F.array().cast("array<int>"))
        return let(starts, lambda st: F.concat(*[joined(p, n, st, 2 * k - 1) for k in (lengths or range(1, max_words + 1))]))

    def joined(p, n, starts, span):
        return F.transform(F.filter(starts, lambda i: i + span - 1 <= n), lambda i: F.array_join(F.slice(p, i, span), ""))

    return let(parts, grams)  # the parts are taken once, not again for each gram


def title_windows(c: Column, sizes: Sequence[int] = (2, 3, 4)) -> Column:
    """The whole title followed by its 2-, 3- and 4-word windows."""
    w = words(c)
    out = [F.array(c)]

    def windows(k):
        idx = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(
            F.array().cast("array<int>"))
        return F.transform(idx, lambda i: F.array_join(F.slice(w, i, k), " "))

    return F.concat(*out, *[windows(k) for k in sizes])


# --- line predicates -------------------------------------------------------------------------
BULLET = lx.BULLET
TITLE_CASE_LINE = lx.TITLE_CASE_LINE
TITLE_WORD = r"(?iU)\b(" + "|".join(lx.TITLE_WORDS) + r")\b"
TITLE_SPLIT = lx.TITLE_SPLIT
PERSON_WORD = lx.PERSON_WORD


def is_bullet(c: Column) -> Column:
    return c.rlike(BULLET) | (c.startswith("-") & (F.length(c) > 2))


def drop_bullet(c: Column) -> Column:
    return strip(F.regexp_replace(c, BULLET, ""))


def has_title_word(c: Column) -> Column:
    return c.rlike(TITLE_WORD)


def is_person_name(c: Column) -> Column:
    w = words(c)
    return ((F.size(w) > 1) & (F.size(w) <= 4)
            & F.forall(w, lambda x: x.rlike(PERSON_WORD)) & ~has_title_word(c))


def has_street_word(c: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(c), r"[\s\-]+"), lit_array(lx.STREET_WORDS))


def is_header_line(text: Column, size: Column, bold: Column, body_size: Column) -> Column:
    """Section-header test for positioned lines: typography or text pattern, 80 characters at most."""
    t = strip(text)
    typo = (size > body_size * 1.08) | (bold & (size >= body_size * 0.95))
    return (t != "") & (F.length(t) <= 80) & (typo | _header_pattern(t))


def _header_pattern(t: Column) -> Column:
    return is_upper(t) | t.endswith(":") | t.rlike(TITLE_CASE_LINE)


def is_header_text(line: Column) -> Column:
    """Section-header test for plain text: 60 characters at most."""
    t = strip(line)
    pattern = is_upper(t) | t.endswith(":") | t.rlike(r"^[A-Z][A-Za-z\s&/]+$")
    return (t != "") & (F.length(t) <= 60) & pattern


def section_name(line: Column) -> Column:
    """First section whose opening phrase starts the line, else null."""
    t = strip(F.regexp_replace(F.lower(line), r":+$", ""))
    out = None
    for name, pattern in lx.SECTION_PATTERNS.items():
        hit = t.rlike("(?iU)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def split_title(c: Column) -> Column:
    return F.transform(F.split(c, TITLE_SPLIT), strip)


def first_title_segment(c: Column) -> Column:
    return F.get(F.filter(split_title(c), lambda s: (s != "") & has_title_word(s)), F.lit(0))


def job_title_from(header_text: Column) -> Column:
    """First title-bearing segment of the first line that is a title and not a person's name."""
    lines = F.transform(F.split(header_text, "\n"), strip)
    good = F.filter(lines, lambda t: (t != "") & ~is_person_name(t) & has_title_word(t))
    segments = F.flatten(F.transform(good, lambda t: F.filter(
        split_title(t), lambda s: (s != "") & has_title_word(s))))
    return F.get(segments, F.lit(0))


# --- metrics and action words ----------------------------------------------------------------
def has_metric(c: Column) -> Column:
    hit = F.lit(False)
    for pattern in lx.METRIC_PATTERNS:
        hit = hit | c.rlike(pattern.replace("(?i)", "(?iU)"))
    return hit


def has_action_word(c: Column, words_: Sequence[str] | None = None) -> Column:
    tokens = F.regexp_extract_all(F.lower(c), F.lit(rf"{WORD}+"), F.lit(0))
    return F.arrays_overlap(tokens, lit_array(words_ or lx.action_words()))

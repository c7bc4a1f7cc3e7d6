"""Skill expressions: literal-lexicon matching inside a row, normalising, categorising."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions.arrays import let
from sparkfolio.functions.text import WORD, lit_array, strip, text_parts

_TOKEN = re.compile(r"\w+")


def lexicon_shape(terms: list[str]) -> tuple[int, bool]:
    """(longest term in words, whether a term starts or ends with a symbol)."""
    longest = max((len(_TOKEN.findall(t)) for t in terms), default=1)
    edges = any(not (re.match(r"\w", t) and re.search(r"\w$", t)) for t in terms)
    return max(1, longest), edges


def term_hits(parts: Column, terms: list[str]) -> Column:
    """Occurrences of literal terms in ``text_parts`` output (repeats kept).

    Longer n-grams are only built where their first word starts a term, so the cost per word is
    one hash lookup whatever the size of the lexicon.
    """
    low = sorted({t.lower() for t in terms})
    plain = [t for t in low if re.match(r"\w", t) and re.search(r"\w$", t)]
    edged = [t for t in low if t not in plain and _TOKEN.search(t)]
    by_len: dict[int, list[str]] = {}
    for t in plain:
        by_len.setdefault(len(_TOKEN.findall(t)), []).append(t)
    n = F.size(parts)
    first = F.when(F.get(parts, F.lit(0)).rlike(f"^{WORD}"), 1).otherwise(2)
    starts = F.when(n >= first, F.sequence(first, n, F.lit(2))).otherwise(F.array().cast("array<int>"))
    out = []

    def one_word(group):
        return F.filter(parts, lambda g: g.isin(*group))

    def several_words(k, group):
        heads = sorted({_TOKEN.match(t).group() for t in group})
        span = 2 * k - 1
        at = F.filter(starts, lambda i: F.get(parts, i - 1).isin(*heads) & (i + span - 1 <= n))
        grams = F.transform(at, lambda i: F.array_join(F.slice(parts, i, span), ""))
        return F.filter(grams, lambda g: g.isin(*group))

    def with_symbols(t):
        found = list(_TOKEN.finditer(t))
        lead, core, tail = t[:found[0].start()], t[found[0].start():found[-1].end()], t[found[-1].end():]
        span = 2 * len(found) - 1

        def fits(i):
            ok = F.get(parts, i - 1) == found[0].group()
            if span > 1:
                ok = ok & (F.array_join(F.slice(parts, i, span), "") == core)
            if tail:
                sep = F.coalesce(F.get(parts, i + span - 1), F.lit(""))
                ok = ok & sep.startswith(tail) & ((F.length(sep) > len(tail)) | (i + span == n))
            if lead:
                sep = F.coalesce(F.when(i > 1, F.get(parts, i - 2)), F.lit(""))
                ok = ok & sep.endswith(lead) & ((F.length(sep) > len(lead)) | (i == 2))
            return ok

        return F.transform(F.filter(starts, fits), lambda i: F.lit(t))

    for k, group in sorted(by_len.items()):
        out.append(one_word(group) if k == 1 else several_words(k, group))
    out += [with_symbols(t) for t in edged]
    return F.concat(*out) if out else F.array().cast("array<string>")


def with_grams(df: DataFrame, text: Column, out: str, terms: list[str]) -> DataFrame:
    """Add the occurrences of the terms in ``text``."""
    return df.withColumn(out, grams_in(text, terms))


def grams_in(text: Column, terms: list[str]) -> Column:
    """Occurrences of literal terms in a text (array<string>, repeats kept)."""
    return let(text_parts(F.coalesce(text, F.lit(""))), lambda p: term_hits(p, terms))


def skills_by_category(hits: Column, lexicon: dict[str, list[str]]) -> Column:
    """map category -> matched skills in lexicon order."""
    pairs = []
    for category, skills in lexicon.items():
        pairs += [F.lit(category), F.array_intersect(lit_array([s.lower() for s in skills]), hits)]
    return F.create_map(*pairs)


def all_skills(lexicon: dict[str, list[str]]) -> list[str]:
    return [s.lower() for skills in lexicon.values() for s in skills]


def flat_skills(skills: Column, order: list[str] = tuple(lx.SKILL_FLAT_ORDER)) -> Column:
    """Skills of a category map as one list, categories in declared order."""
    empty = F.array().cast("array<string>")
    return F.concat(*[F.coalesce(F.try_element_at(skills, F.lit(c)), empty) for c in order])


def alternation_skills(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """Sorted distinct leftmost matches of one alternation over all skills (alphabetical order)."""
    names = sorted(set(all_skills(lexicon)))
    body = "|".join(re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", n) for n in names)
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_])"), F.lit(0))
    return F.sort_array(F.array_distinct(found))


def normalise_skill(c: Column) -> Column:
    """Leading verb removed; null when empty, longer than three words or a generic single word."""
    cleaned = F.regexp_replace(F.lower(strip(c)), "(?i)" + lx.SKILL_VERB_PREFIX, "")
    n = F.size(F.filter(F.split(cleaned, r"\s+"), lambda w: w != ""))
    bad = (cleaned == "") | (n > 3) | ((n == 1) & cleaned.isin(*lx.GENERIC_SKILL_WORDS))
    return F.when(~bad, cleaned)


def categorise_skill(c: Column) -> Column:
    """First category with a pattern found in the skill, else ``other``."""
    low = F.lower(c)
    out = None
    for category, patterns in lx.CATEGORY_PATTERNS.items():
        hit = low.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns))
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("other")

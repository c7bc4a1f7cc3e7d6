"""Contact, address and salary expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio.functions.text import has_street_word, strip, title_case

# Fixed formats.
EMAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE = (r"(?:\+33\s?|0)(?:[67]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{2}"
         r"|\d[\s.\-]?\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2}[\s.\-]?\d{2})")
GITHUB = r"(?iU)github\.com/[\w\-]+(?:/[\w\-]+)?"
LINKEDIN = r"(?iU)linkedin\.com/in/[\w\-]+"
URL = r"(?i)https?://[^\s]+|www\.[^\s]+"
CITY = r"([A-ZÀ-Ý][\wà-öù-ÿ'-]*(?:[ \t-][A-ZÀ-Ý][\wà-öù-ÿ'-]*)*)"
POSTAL_FIRST = r"(?U)\b(\d{5})\b[ \t,–—-]*" + CITY
POSTAL_ANY = r"(?U)(?:\b(\d{5})\b[ \t,–—-]*" + CITY + r"|" + CITY + r"[ \t]*,[ \t]*\b(\d{5})\b)"
PROPER_RUN = r"(?U)[A-ZÀ-Ý][\wà-öù-ÿ'-]*(?:[\s,-]+[A-ZÀ-Ý][\wà-öù-ÿ'-]*)*"


def _first(c: Column, pattern: str) -> Column:
    """First match or null (``regexp_substr`` is null when nothing matches)."""
    return F.regexp_substr(c, F.lit(pattern))


def email(c: Column) -> Column:
    return _first(c, EMAIL)


def phone(c: Column) -> Column:
    return strip(_first(c, PHONE))


def github(c: Column) -> Column:
    return _first(c, GITHUB)


def linkedin(c: Column) -> Column:
    return _first(c, LINKEDIN)


def url(c: Column) -> Column:
    return _first(c, URL)


def has_contact(c: Column, links: bool = True) -> Column:
    hit = c.rlike(EMAIL) | c.rlike(PHONE)
    return hit | c.rlike(GITHUB) | c.rlike(LINKEDIN) if links else hit


def _group(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def postal_code(c: Column) -> Column:
    return F.coalesce(_group(c, POSTAL_FIRST, 1), _group(c, POSTAL_ANY, 1), _group(c, POSTAL_ANY, 4))


def city(c: Column) -> Column:
    found = F.coalesce(_group(c, POSTAL_FIRST, 2), _group(c, POSTAL_ANY, 2), _group(c, POSTAL_ANY, 3))
    return title_case(strip(found))


def _pairs(c: Column, pattern: str, city_group: int, code_group: int) -> Column:
    """(city, code) of all matches whose city has no street word, in text order."""
    found = F.zip_with(
        F.regexp_extract_all(c, F.lit(pattern), F.lit(city_group)),
        F.regexp_extract_all(c, F.lit(pattern), F.lit(code_group)),
        lambda a, b: F.struct(title_case(strip(a)).alias("city"), b.alias("code")))
    return F.filter(found, lambda p: (p["city"] != "") & ~has_street_word(p["city"]))


def cascade_location(structured_city: Column, structured_code: Column, raw_text: Column,
                     job_title: Column, entity_city: Column) -> Column:
    """struct(city, code): structured, then postal-first, city-first, title, entity."""
    steps = [(raw_text, POSTAL_FIRST, 2, 1), (raw_text, POSTAL_ANY, 3, 4),
             (job_title, POSTAL_FIRST, 2, 1), (job_title, POSTAL_ANY, 3, 4)]
    found = F.coalesce(*[F.get(_pairs(F.coalesce(t, F.lit("")), p, a, b), F.lit(0))
                         for t, p, a, b in steps])
    known = structured_city.isNotNull() & (structured_city != "")
    return F.when(known, F.struct(structured_city.alias("city"), structured_code.alias("code"))) \
        .otherwise(F.struct(
            F.coalesce(found["city"], entity_city).alias("city"),
            F.coalesce(structured_code, found["code"]).alias("code")))


def longest_proper_run(c: Column) -> Column:
    """Longest capitalised run, first on ties, outer blanks, commas and dashes removed."""
    runs = F.regexp_extract_all(c, F.lit(PROPER_RUN), F.lit(0))
    best = F.sort_array(F.transform(runs, lambda r, i: F.struct(
        (-F.length(r)).alias("neg"), i.alias("i"), r.alias("r"))))
    return F.regexp_replace(F.get(best, F.lit(0))["r"], r"^[ ,\-]+|[ ,\-]+$", "")


def entity_location(header_text: Column, candidates: Column) -> Column:
    """Postal match in the header, else the candidate place standing first in the header.

    ``candidates`` is an array<string> of place names; blocklisted words and street names are
    dropped, each candidate is reduced to its longest proper-noun run, repeats removed.
    """
    from sparkfolio import lexicon as lx

    kept = F.filter(candidates, lambda x: ~F.lower(strip(x)).isin(*lx.LOCATION_BLOCKLIST)
                    & ~has_street_word(x))
    cleaned = F.array_distinct(F.filter(F.transform(kept, longest_proper_run),
                                        lambda x: x.isNotNull() & (x != "")))
    placed = F.sort_array(F.transform(
        F.filter(cleaned, lambda x: F.contains(header_text, x)),
        lambda x: F.struct(F.instr(header_text, x).alias("at"), x.alias("x"))))
    in_header = F.get(placed, F.lit(0))["x"]
    postal = F.coalesce(_group(header_text, POSTAL_ANY, 2), _group(header_text, POSTAL_ANY, 3))
    return F.coalesce(title_case(strip(postal)), in_header, F.get(cleaned, F.lit(0)))


def department_code(location: Column) -> Column:
    digits = F.regexp_replace(location, r"\D", "")
    n = F.length(digits)
    return F.when(n >= 5, F.substring(digits, 1, 2)).when(n.isin(2, 3), digits)


def salary_min_thousands(c: Column) -> Column:
    """First number, blanks, commas and dots taken as thousands marks."""
    digits = F.regexp_replace(F.regexp_substr(c, F.lit(r"\d[\d\s.,]*")), r"[ ,.]", "")
    return strip(digits).try_cast("double")


def salary_min_decimal(c: Column) -> Column:
    """First number, comma or dot taken as the decimal mark."""
    return F.replace(F.regexp_substr(c, F.lit(r"\d+(?:[.,]\d+)?")), F.lit(","), F.lit(".")).try_cast("double")

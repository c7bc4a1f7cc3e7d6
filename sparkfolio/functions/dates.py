"""Dates of career entries: parsing, ranges, durations.

``as_of`` is a (year, month) pair standing for "today", so results can be reproduced.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio.functions.arrays import let

# Fixed formats.
_MONTH = (r"(?:janv(?:ier)?|january|jan|fév(?:r(?:ier)?)?|fev(?:r(?:ier)?)?|feb(?:ruary)?|mars|march|mar"
          r"|avr(?:il)?|apr(?:il)?|mai|may|juin|juil(?:let)?|june?|july?|ao[uû]t?|aug(?:ust)?"
          r"|sept(?:embre|ember)?|sep|oct(?:obre|ober)?|nov(?:embre|ember)?|d[eé]c(?:embre|ember)?)")
_OPEN = r"(?:present|aujourd['’`]?hui|en\s*cours|current|maintenant|now|présent|actuel)"
RANGE = (rf"(?iU)((?:{_MONTH}\.?\s+)?[12]\d{{3}})\s*[-–—/]\s*"
         rf"((?:{_MONTH}\.?\s+)?(?:[12]\d{{3}}|{_OPEN}))")
MONTH_YEAR = rf"(?iU)\b({_MONTH})[\s./]*([12]\d{{3}})\b"
YEAR = r"(?U)\b(?:19|20)\d{2}\b"
OPEN_END = rf"(?iU)\b{_OPEN}\b"
DURATION = r"(?iU)\b(\d+)\s*(?:mois|months?)\b|\b(\d+)(?:[.,]\d+)?\s*(?:ans?|years?)\b"
YEAR_SPAN = (r"(?iU)\b((?:19|20)\d{2})\s*[-–—]\s*"
             r"((?:19|20)\d{2}|present|current|now|today|aujourd|en\s*cours|présent)\b")

_MONTH_NUMBERS = {
    "jan": 1, "fev": 2, "feb": 2, "mar": 3, "avr": 4, "apr": 4, "mai": 5, "may": 5, "jun": 6,
    "jul": 7, "aou": 8, "aug": 8, "sep": 9, "oct": 10, "nov": 11, "dec": 12,
}


def _month_number(name: Column) -> Column:
    plain = F.translate(F.lower(name), "éèû", "eeu")
    three = F.substring(plain, 1, 3)
    numbers = F.create_map(*[F.lit(x) for kv in _MONTH_NUMBERS.items() for x in kv])
    return (F.when(plain.startswith("juin"), 6).when(plain.startswith("juil"), 7)
            .otherwise(F.coalesce(F.try_element_at(numbers, three), F.lit(1))))


def month_year(c: Column) -> Column:
    """struct(y, m) of a date text; m is 0 when only a year is given; null when open or undated."""
    lead = rf"(?iU)^({_MONTH})[\s./]*([12]\d{{3}})\b"
    opened = "(?iU)^" + _OPEN + r"\b"

    def parse(t):
        year_m = F.nullif(F.regexp_extract(t, lead, 2), F.lit("")).cast("int")
        year_o = F.regexp_substr(t, F.lit(YEAR)).cast("int")
        return (F.when(t.rlike(opened), F.lit(None))
                .when(t.rlike(lead), F.struct(
                    year_m.alias("y"), _month_number(F.regexp_extract(t, lead, 1)).alias("m")))
                .when(t.rlike(YEAR), F.struct(year_o.alias("y"), F.lit(0).alias("m"))))

    return let(F.trim(c), parse)


def date_text(d: Column) -> Column:
    """``YYYY`` or ``YYYY-MM``."""
    return F.when(d["m"] == 0, d["y"].cast("string")).otherwise(
        F.format_string("%d-%02d", d["y"], d["m"]))


def months_between(start: Column, end: Column) -> Column:
    first = F.greatest(start["m"], F.lit(1))
    last = F.greatest(end["m"], F.lit(1))
    return F.greatest(F.lit(0), (end["y"] - start["y"]) * 12 + last - first)


def contains_date(c: Column) -> Column:
    return c.rlike(r"[12]\d{3}") & (c.rlike(YEAR) | c.rlike(RANGE) | c.rlike(MONTH_YEAR))


def date_range(c: Column, as_of: tuple[int, int]) -> Column:
    """struct(date_start, date_end, months, is_current) of one line.

    An explicit duration wins, then the first readable range, then lone years.
    """
    now = F.struct(F.lit(as_of[0]).alias("y"), F.lit(as_of[1]).alias("m"))
    null_s, null_i = F.lit(None).cast("string"), F.lit(None).cast("int")

    def result(start, end, months, current):
        return F.struct(start.alias("date_start"), end.alias("date_end"),
                        months.cast("int").alias("months"), F.lit(current).alias("is_current"))

    def lone_years(years):
        first, last = F.get(years, F.lit(0)), F.get(years, F.size(years) - 1)
        gap = (last.cast("int") - first.cast("int")) * 12
        return (F.when(F.size(years) == 1, result(first, null_s, null_i, False))
                .when(F.size(years) >= 2, result(first, last, F.when(gap > 0, gap), False))
                .otherwise(result(null_s, null_s, null_i, False)))

    def from_span(span):
        end = F.when(span["open"], F.lit("present")).otherwise(date_text(span["e"]))
        months = months_between(span["s"], F.when(span["open"], now).otherwise(span["e"]))
        return F.struct(date_text(span["s"]).alias("date_start"), end.alias("date_end"),
                        months.cast("int").alias("months"), span["open"].alias("is_current"))

    def spans_of(x):
        return F.filter(F.transform(F.regexp_extract_all(x, F.lit(RANGE), F.lit(0)), lambda r: F.struct(
            month_year(F.regexp_extract(r, RANGE, 1)).alias("s"),
            month_year(F.regexp_extract(r, RANGE, 2)).alias("e"),
            F.regexp_extract(r, RANGE, 2).rlike(OPEN_END).alias("open"))),
            lambda x: x["s"].isNotNull() & (x["open"] | x["e"].isNotNull()))

    def read_ranges(x):
        return let(spans_of(x), lambda spans: F.when(
            F.size(spans) > 0, from_span(F.get(spans, F.lit(0)))).otherwise(
                let(F.regexp_extract_all(x, F.lit(YEAR), F.lit(0)), lone_years)))

    def read(x):
        dm = F.nullif(F.regexp_extract(x, DURATION, 1), F.lit("")).try_cast("int")
        dy = F.nullif(F.regexp_extract(x, DURATION, 2), F.lit("")).try_cast("int")
        return let(F.coalesce(F.when(dm > 0, dm), dy * 12), lambda explicit: F.when(
            explicit > 0, result(null_s, null_s, explicit, False)).otherwise(read_ranges(x)))

    return let(c, read)


def year_month(c: Column) -> Column:
    """struct(y, m) from ``YYYY``, ``YYYY-MM`` or ``MM/YYYY``; null for present or bad text."""
    slash = F.split(c, "/")
    dash = F.split(c, "-")
    y = F.when(c.contains("/"), F.when(F.size(slash) == 2, F.get(slash, F.lit(1)).try_cast("int"))) \
        .otherwise(F.get(dash, F.lit(0)).try_cast("int"))
    m = F.when(c.contains("/"), F.get(slash, F.lit(0)).try_cast("int")) \
        .when(F.size(dash) > 1, F.get(dash, F.lit(1)).try_cast("int")).otherwise(F.lit(1))
    ok = c.isNotNull() & (c != "") & (c != "present") & y.isNotNull() & m.isNotNull()
    return F.when(ok, F.struct(y.alias("y"), m.alias("m")))


def month_index(d: Column) -> Column:
    return d["y"] * 12 + d["m"]


def years_from_spans(c: Column, current_year: int) -> Column:
    """Sum of year spans in a text; open spans end in the current year; null when none counts."""
    firsts = F.regexp_extract_all(c, F.lit(YEAR_SPAN), F.lit(1))
    lasts = F.regexp_extract_all(c, F.lit(YEAR_SPAN), F.lit(2))
    spans = F.zip_with(firsts, lasts, lambda a, b: F.struct(
        a.cast("int").alias("s"), F.coalesce(b.try_cast("int"), F.lit(current_year)).alias("e")))
    total = F.aggregate(
        F.filter(spans, lambda x: (x["s"] >= 1970) & (x["s"] <= current_year)
                 & (x["e"] >= x["s"]) & (x["e"] <= current_year + 1)),
        F.lit(0), lambda acc, x: acc + x["e"] - x["s"])
    return F.when(total > 0, total.cast("double"))

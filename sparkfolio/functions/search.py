"""Search-query expressions for one record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import contact
from sparkfolio.functions import text as tx
from sparkfolio.functions.arrays import int_range, let

SENIORITY = r"(?iU)\b(junior|senior|lead|principal|staff|intern|associate)\b"
CV_RADIUS_KM = 30


def plain_title(job_title: Column) -> Column:
    """Title without seniority words, cut two words after its last title word."""
    cleaned = tx.strip(F.regexp_replace(F.regexp_replace(job_title, SENIORITY, ""), r"\s+", " "))

    def cut(w):
        last = F.array_max(F.filter(int_range(F.lit(1), F.size(w)), lambda i: tx.has_title_word(F.get(w, i - 1))))
        return F.array_join(F.slice(w, F.lit(1), F.coalesce(last + 2, F.size(w))), " ")

    return let(tx.words(cleaned), cut)


def base_query(job_title: Column, skills_flat: Column) -> Column:
    return F.coalesce(F.nullif(plain_title(job_title), F.lit("")), F.array_join(F.slice(skills_flat, 1, 3), " "))


def synonym_queries(title: Column, groups=tuple(lx.TITLE_SYNONYMS)) -> Column:
    """Up to two other names from the first synonym group the title belongs to."""
    def pick(low):
        out = None
        for canonical, synonyms in groups:
            names = [canonical, *synonyms]
            hit = F.lit(False)
            for n in names:
                hit = hit | F.contains(low, F.lit(n))
            other = F.slice(F.filter(tx.lit_array(names), lambda n: ~F.contains(low, n)), 1, 2)
            out = F.when(hit, other) if out is None else out.when(hit, other)
        return out.otherwise(F.array().cast("array<string>"))

    return let(F.lower(title), pick)


def query_variants(job_title: Column, skills_flat: Column, sector: Column) -> Column:
    """One to three distinct queries: base, first synonym, title with sector."""
    def build(base):
        synonym = F.get(synonym_queries(job_title), F.lit(0))
        rich = F.when(sector.isNotNull() & job_title.isNotNull() & ~F.contains(F.lower(base), F.lower(sector)),
                      F.trim(F.concat(plain_title(job_title), F.lit(" "), sector)))
        found = F.array_distinct(F.array_compact(F.array(base, synonym, F.nullif(rich, F.lit("")))))
        return F.when(base != "", F.slice(found, 1, 3)).otherwise(F.array().cast("array<string>"))

    return let(base_query(job_title, skills_flat), build)


# Departments of the regions, names without accents.
REGIONS = {
    "auvergne-rhone-alpes": "01 03 07 15 26 38 42 43 63 69 73 74", "bourgogne-franche-comte": "21 25 39 58 70 71 89 90", "bretagne": "22 29 35 56",
    "centre-val de loire": "18 28 36 37 41 45", "corse": "20", "grand est": "08 10 51 52 54 55 57 67 68 88", "hauts-de-france": "02 59 60 62 80",
    "ile-de-france": "75 77 78 91 92 93 94 95", "normandie": "14 27 50 61 76", "nouvelle-aquitaine": "16 17 19 23 24 33 40 47 64 79 86 87",
    "occitanie": "09 11 12 30 31 32 34 46 48 65 66 81 82", "pays de la loire": "44 49 53 72 85", "provence-alpes-cote d'azur": "04 05 06 13 83 84",
}


# Names of the whole country, which narrow nothing.
COUNTRY = ("france", "france entiere", "toute la france", "france metropolitaine")
NATIONWIDE = "*"
# A name key of a listing that has a department: only searches without one may use it.
BY_NAME = "~"


def place_names(place: Column) -> Column:
    """Names between the commas, brackets and dashes of a place, without digits and accents, in lower case; no country."""
    plain = F.translate(F.lower(place), "àâäéèêëîïôöùûüç’", "aaaeeeeiioouuuc'")
    words = F.regexp_replace(plain, "[0-9]+(?:(?:er|eme|e)\\b)?(?: +arrondissement)?", " ")
    parts = F.transform(F.split(words, r"[,;()/|]|\s[-–—]\s"), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[^\p{L}]+|[^\p{L}]+$", ""))
    return F.filter(parts, lambda x: (x != "") & ~x.isin(*COUNTRY))


def is_department(key: Column) -> Column:
    return key.rlike("^[0-9]")


def listing_area(location: Column) -> Column:
    """Keys a listing is found by: its department and the names of the place, and the whole country.

    Beside a department the names are marked, so that a town of the same name elsewhere does not answer a search with one."""
    names = F.coalesce(place_names(location), F.array().cast("array<string>"))
    code = contact.department_code(location)
    own = F.when(code.isNotNull(), F.concat(F.array(code), F.transform(names, lambda x: F.concat(F.lit(BY_NAME), x)))).otherwise(names)
    return F.array_distinct(F.concat(own, F.array(F.lit(NATIONWIDE))))


def search_area(place: Column) -> Column:
    """Sorted keys of which a listing must have one: department, town, and for a region also its departments; the whole
    country for a place that names none of them."""
    regions = F.create_map(*(F.lit(x) for name, codes in REGIONS.items() for x in (name, codes)))
    names = place_names(place)
    inside = F.flatten(F.transform(names, lambda x: F.split(F.coalesce(F.try_element_at(regions, x), F.lit("")), " ")))
    code = F.array_compact(F.array(contact.department_code(place)))
    keys = F.array_sort(F.array_distinct(F.filter(F.concat(names, inside, code), lambda x: x != "")))
    return F.when(F.size(keys) == 0, F.array(F.lit(NATIONWIDE))).otherwise(keys)


def asked_keys(area: Column) -> Column:
    """Listing keys that a ``search_area`` meets: its own, and without a department also the names of listings that have one."""
    marked = F.transform(F.filter(area, lambda x: x != NATIONWIDE), lambda x: F.concat(F.lit(BY_NAME), x))
    return F.when(F.exists(area, is_department), area).otherwise(F.concat(area, marked))


def search_place(region: Column, postal: Column, city: Column) -> Column:
    """struct(place, distance): region first, then postal code and city with a 30 km radius."""
    given = region.isNotNull() & (region != "")
    own = F.when(city.isNotNull() & (city != ""), F.concat_ws(" ", F.nullif(postal, F.lit("")), city))
    return F.struct(F.when(given, region).otherwise(own).alias("place"),
                    F.when(~given & own.isNotNull(), F.lit(CV_RADIUS_KM)).alias("distance"))

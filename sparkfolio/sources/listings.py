"""Job listings from three payload formats, their union and first-seen deduplication.

Each reader takes a frame with one raw JSON payload per row; nothing is fetched here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import contact

COLUMNS = ["title", "company", "location", "description", "url", "salary_min", "salary_max",
           "contract_type", "source", "source_color"]
_COLORS = dict(lx.LISTING_SOURCES)


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def _items(payloads: DataFrame, payload: str, root: str, item: str, keep: Sequence[str],
           max_results: int | None = None) -> DataFrame:
    parsed = F.from_json(F.col(payload), f"{root} array<struct<{item}>>", {"mode": "PERMISSIVE"})[root]
    if max_results is not None:
        parsed = F.slice(parsed, 1, max_results)
    return payloads.select(*keep, F.posexplode(parsed).alias("pos", "i"))


def _finish(items: DataFrame, keep: Sequence[str], source: str, **cols: Column) -> DataFrame:
    null_d, null_s = F.lit(None).cast("double"), F.lit(None).cast("string")
    cols = {"salary_min": null_d, "salary_max": null_d, "contract_type": null_s, **cols,
            "source": F.lit(source), "source_color": F.lit(_COLORS[source])}
    return items.select(*keep, "pos", *[cols[c].alias(c) for c in COLUMNS])


def adzuna_listings(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = ()) -> DataFrame:
    items = _items(payloads, payload, "results", (
        "title:string,company:struct<display_name:string>,location:struct<display_name:string>,"
        "description:string,redirect_url:string,salary_min:double,salary_max:double,contract_type:string"), keep)
    i = F.col("i")
    return _finish(items, keep, "adzuna", title=_text(i["title"]), company=_text(i["company"]["display_name"]),
                   location=_text(i["location"]["display_name"]), description=_text(i["description"]),
                   url=F.coalesce(i["redirect_url"], F.lit("")), salary_min=i["salary_min"],
                   salary_max=i["salary_max"], contract_type=i["contract_type"])


def jooble_listings(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = (),
                    max_results: int = 20) -> DataFrame:
    items = _items(payloads, payload, "jobs", (
        "title:string,location:string,snippet:string,salary:string,company:string,link:string,type:string"),
        keep, max_results)
    i = F.col("i")
    return _finish(items, keep, "jooble", title=_text(i["title"]), company=_text(i["company"]),
                   location=_text(i["location"]), description=_text(i["snippet"]),
                   url=F.coalesce(i["link"], F.lit("")), salary_min=contact.salary_min_thousands(i["salary"]))


def france_travail_listings(payloads: DataFrame, payload: str = "payload", keep: Sequence[str] = (),
                            max_results: int = 20) -> DataFrame:
    items = _items(payloads, payload, "resultats", (
        "intitule:string,entreprise:struct<nom:string>,lieuTravail:struct<libelle:string>,description:string,"
        "origineOffre:struct<urlOrigine:string>,salaire:struct<libelle:string>"), keep, max_results)
    i = F.col("i")
    return _finish(items, keep, "france_travail", title=_text(i["intitule"]),
                   company=F.coalesce(F.nullif(_text(i["entreprise"]["nom"]), F.lit("")), F.lit("Non précisé")),
                   location=_text(i["lieuTravail"]["libelle"]), description=_text(i["description"]),
                   url=F.coalesce(i["origineOffre"]["urlOrigine"], F.lit("")),
                   salary_min=contact.salary_min_decimal(i["salaire"]["libelle"]))


def source_order(source: Column, order: Sequence[tuple[str, str]] = tuple(lx.LISTING_SOURCES)) -> Column:
    names = [n for n, _ in order]
    return F.array_position(F.array(*[F.lit(n) for n in names]), source)


def union_sources(frames: Sequence[DataFrame], active: Sequence[str] | None = None) -> DataFrame:
    """All sources in one frame; ``active`` keeps the named sources only (None keeps all)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out if active is None else out.filter(F.col("source").isin(*active))


def first_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row per key in the given order.

    An aggregate, not a window: each task keeps one row per key before the shuffle, so a key
    holding a third of all rows costs no more than any other.
    """
    rest = [c for c in df.columns if c not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return df.groupBy(*keys).agg(row).select(*[F.col(k) for k in keys], *[F.col(f"_r.{c}").alias(c) for c in rest]) \
        .select(*df.columns)


def duplicates_removed(df: DataFrame, keys: Sequence[str], url: str = "url") -> DataFrame:
    """(keys, seen, kept, duplicates_removed): two partial aggregates, no distinct on raw rows."""
    per_url = df.groupBy(*keys, url).agg(F.count("*").alias("c"))
    return per_url.groupBy(*keys).agg(F.sum("c").alias("seen"), F.count("*").alias("kept")) \
        .withColumn("duplicates_removed", F.col("seen") - F.col("kept"))


def salary_only(df: DataFrame) -> DataFrame:
    """Rows with a pay figure; 0 counts as none."""
    return df.filter((F.coalesce("salary_min", F.lit(0.0)) != 0) | (F.coalesce("salary_max", F.lit(0.0)) != 0))

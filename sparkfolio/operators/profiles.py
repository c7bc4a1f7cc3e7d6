"""Profile detection from keyword coverage and title similarity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import text as tx
from sparkfolio.functions.arrays import let
from sparkfolio.session import persisted

CONFIDENT = 0.3
PART = 50_000  # profiles of a catalogue that a task holds at a time
BEST = 4  # the best and three others
SLICE = 256  # rows of a batch whose texts are Python strings at a time
PAIRS = 100_000  # rows of records times profiles in a batch


@dataclass
class Profile:
    profile_id: str
    sector: str
    job_title: str
    aliases: list[str] = field(default_factory=list)
    keywords: list[str] = field(default_factory=list)
    sector_key: str = ""


def skills_text(skills_flat: Column, sections: Column) -> Column:
    return F.lower(F.concat(F.array_join(skills_flat, " "), F.lit(" "), F.coalesce(F.try_element_at(sections, F.lit("skills")), F.lit(""))))


def experience_text(experience: Column, sections: Column, raw_text: Column) -> Column:
    """Bullets and experience section; the whole text when both are empty."""
    bullets = F.array_join(F.flatten(F.transform(experience, lambda e: e["bullets"])), " ")
    own = tx.strip(F.lower(F.concat(bullets, F.lit(" "), F.coalesce(F.try_element_at(sections, F.lit("experience")), F.lit("")))))
    return F.when(own != "", own).otherwise(F.lower(raw_text))


def coverage(keywords: Sequence[str], text_lower: Column) -> Column:
    """Share of keywords contained in the text, 0 without keywords."""
    if not keywords:
        return F.lit(0.0)
    hits = F.lit(0)
    for k in keywords:
        hits = hits + F.contains(text_lower, F.lit(k.lower())).cast("int")
    return hits / len(keywords)


def profile_scores(profiles: Sequence[Profile], skills: Column, experience: Column, title_scores: Column | None = None) -> Column:
    """array<struct<id,title,skills,exp,score,ord>> of every profile for one record, as one expression: for a handful of profiles that a
    caller states. ``detect`` and ``profile_coverage`` take catalogues of any size."""
    def all_of(s):
        rows = []
        for i, p in enumerate(profiles):
            title = F.lit(0.0) if title_scores is None else F.coalesce(F.try_element_at(title_scores, F.lit(p.profile_id)), F.lit(0.0))
            rows.append(F.struct(
                F.lit(p.profile_id).alias("id"), title.alias("title"), coverage(p.keywords, s["sk"]).alias("skills"),
                coverage(p.keywords, s["ex"]).alias("exp"), F.lit(i).alias("ord")))
        return F.transform(F.array(*rows), lambda r: F.struct(
            r["id"].alias("id"), r["title"].alias("title"), r["skills"].alias("skills"), r["exp"].alias("exp"),
            (r["title"] * 0.4 + r["skills"] * 0.35 + r["exp"] * 0.25).alias("score"), r["ord"].alias("ord")))

    return let(F.struct(skills.alias("sk"), experience.alias("ex")), all_of)


CATALOGUE_SCHEMA = "ord long, profile_id string, sector string, job_title string, keywords array<string>"
_TOP = "array<struct<neg:double,ord:bigint,id:string,sector:string,job_title:string>>"


def as_table(spark: SparkSession, profiles: Sequence[Profile] | DataFrame) -> DataFrame:
    """A catalogue as rows (ord, profile_id, sector, job_title, keywords); ``ord`` decides ties. Tables without one are taken by profile_id; a
    profile that is there twice counts once, and one without an id not at all."""
    if not isinstance(profiles, DataFrame):
        return spark.createDataFrame([(i, p.profile_id, p.sector, p.job_title, p.keywords) for i, p in enumerate(profiles)], CATALOGUE_SCHEMA)
    order = F.col("ord").cast("long") if "ord" in profiles.columns else F.lit(0).cast("long")
    return (profiles.filter("profile_id is not null").select(order.alias("ord"), "profile_id", "sector", "job_title", "keywords")
            .dropDuplicates(["profile_id"]))


class _Catalogue:
    """One automaton for the distinct keywords of a part of a catalogue, and the groups of profiles with the same keywords.

    ``rows`` are in the order that decides ties. Groups stand in the order of their first profiles.
    """

    def __init__(self, rows: list):
        import ahocorasick

        self.rows = rows
        groups: dict[tuple, list[int]] = {}
        for i, r in enumerate(rows):
            groups.setdefault(tuple(sorted(k.lower() for k in (r["keywords"] or []) if k is not None)), []).append(i)
        self.members = list(groups.values())
        self.group = np.zeros(len(rows), np.int64)
        for g, m in enumerate(self.members):
            self.group[m] = g
        self.sizes = np.array([len(k) for k in groups], float)
        self.always = np.array([k.count("") for k in groups], float)  # the empty keyword stands in every text
        owners: dict[str, dict[int, int]] = {}
        for g, keywords in enumerate(groups):
            for k in keywords:
                if k:
                    held = owners.setdefault(k, {})
                    held[g] = held.get(g, 0) + 1
        self.owners = [(np.array(list(h)), np.array(list(h.values()), float)) for h in owners.values()]
        self.found = ahocorasick.Automaton()
        for i, k in enumerate(owners):
            self.found.add_word(k, i)
        if owners:
            self.found.make_automaton()
        self.at = {r["profile_id"]: i for i, r in enumerate(rows)}

    def coverage(self, text: str | None) -> np.ndarray:
        """Share of each group's keywords that the lower-cased text contains; 0 without keywords."""
        hits = self.always.copy()
        if self.owners and text:
            for i in {i for _, i in self.found.iter(text)}:
                mine, times = self.owners[i]
                hits[mine] += times
        return np.divide(hits, self.sizes, out=np.zeros(len(hits)), where=self.sizes > 0)

    def best(self, skills: str | None, experience: str | None, titles) -> list[tuple[float, int]]:
        """(score, row) of the best profiles. A profile of the best has fewer than BEST groups before its own, but for groups whose first
        profiles have a title score; those with one are scored by themselves."""
        titled = {self.at[k]: v for k, v in titles or () if v and k in self.at}
        s, e = self.coverage(skills), self.coverage(experience)
        base, n = 0.0 * 0.4 + s * 0.35 + e * 0.25, BEST + len(titled)
        if len(base) > n:
            least = np.partition(base, len(base) - n)[len(base) - n]
            groups = np.concatenate([np.flatnonzero(base > least), np.flatnonzero(base == least)[:n]])
        else:
            groups = range(len(base))
        out = [(float(base[g]), i) for g in groups for i in self.members[g][:n] if i not in titled]
        out += [(float(v * 0.4 + s[self.group[i]] * 0.35 + e[self.group[i]] * 0.25), i) for i, v in titled.items()]
        return sorted(out, key=lambda x: (-x[0], x[1]))[:BEST]


def _reduced(table: DataFrame) -> DataFrame:
    """The first BEST profiles of those with equal keywords: without title scores no other can be among the best."""
    order = Window.partitionBy(F.sort_array("keywords")).orderBy("ord", "profile_id")
    return table.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= BEST).drop("_r")


def _parts(table: DataFrame) -> list:
    """Broadcast parts of the catalogue, PART profiles each. A part is what the driver and a task hold at a time."""
    n = max(1, -(-table.count() // PART))
    dealt = persisted(table.withColumn("part", F.pmod(F.xxhash64("profile_id"), F.lit(n))), "catalogue") if n > 1 else table.withColumn("part", F.lit(0))
    for i in range(n):
        yield table.sparkSession.sparkContext.broadcast([r.asDict() for r in dealt.filter(F.col("part") == i).orderBy("ord", "profile_id").collect()])


def _texts(cv: DataFrame, title_scores: Column | None) -> DataFrame:
    titles = title_scores if title_scores is not None else F.lit(None)
    return cv.select("doc_id", skills_text(F.col("skills_flat"), F.col("sections")).alias("sk"),
                     experience_text(F.col("experience"), F.col("sections"), F.col("raw_text")).alias("ex"), titles.cast("map<string,double>").alias("titles"))


def _slices(batches, rows: int = SLICE):
    """A batch's rows a few at a time as Python lists, so that a task holds the texts of a batch once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows).to_pydict()


def profile_coverage(cv: DataFrame, profiles: Sequence[Profile] | DataFrame, title_scores: Column | None = None) -> DataFrame:
    """(doc_id, profile_id, title, skills, exp, score) of every record and profile, for a catalogue of any size.

    Each task reads a text once with an automaton of all keywords, whatever their number. The result has records times profiles rows; ``detect`` keeps
    the best and never makes them.
    """
    schema = "doc_id long, profile_id string, title double, skills double, exp double, score double"
    out = None
    for part in _parts(as_table(cv.sparkSession, profiles)):
        def run(batches, part=part):
            import pyarrow as pa

            catalogue = _Catalogue(part.value)
            ids = [r["profile_id"] for r in part.value]
            names, width = pa.array(ids, pa.string()), max(1, len(ids))
            for b in _slices(batches, max(1, min(SLICE, PAIRS // width))):
                n = len(b["doc_id"])
                t = np.zeros((n, len(ids)))
                for row, titles in zip(t, b["titles"], strict=True):
                    for k, v in titles or ():
                        if v and k in catalogue.at:
                            row[catalogue.at[k]] = v
                s, e = (np.array([catalogue.coverage(x)[catalogue.group] for x in b[c]]).reshape(t.shape) for c in ("sk", "ex"))
                docs = pa.array(b["doc_id"], pa.int64()).take(pa.array(np.repeat(np.arange(n), len(ids))))
                yield pa.RecordBatch.from_arrays([docs, names.take(pa.array(np.tile(np.arange(len(ids)), n))),
                                                  *(pa.array(x.ravel()) for x in (t, s, e, t * 0.4 + s * 0.35 + e * 0.25))],
                                                 names=["doc_id", "profile_id", "title", "skills", "exp", "score"])

        more = _texts(cv, title_scores).mapInArrow(run, schema)
        out = more if out is None else out.unionByName(more)
    return out


def chosen(top: Column) -> Column:
    """struct(profile_id, sector, job_title, confidence, alternatives) from the best profiles, best first."""
    def choose(r):
        best = F.get(r, F.lit(0))
        conf = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(-best["neg"], F.lit(0.0))))
        sure = conf >= CONFIDENT
        alt = F.slice(r, F.when(sure, 2).otherwise(1), F.lit(3))
        return F.struct(
            F.when(sure, best["id"]).otherwise(lx.GENERIC_PROFILE_ID).alias("profile_id"),
            F.when(sure, best["sector"]).otherwise(lx.GENERIC_SECTOR).alias("sector"),
            F.when(sure, best["job_title"]).otherwise(lx.GENERIC_TITLE).alias("job_title"),
            F.round(conf, 3).alias("confidence"),
            F.transform(alt, lambda a: F.struct(a["id"].alias("id"), F.round(-a["neg"], 3).alias("score"))).alias("alternatives"))

    return let(top, choose)


def detect(cv: DataFrame, profiles: Sequence[Profile] | DataFrame, title_scores: Column | None = None) -> DataFrame:
    """(doc_id, profile_id, sector, job_title, confidence, alternatives) for a catalogue of any size: a list, or a table like ``sources.profiles``.

    Profiles with the same keywords are scored once, and without title scores only the first few of them are taken at all. Up to PART profiles stay
    row-local: texts meet an automaton of all keywords in their task, and the best four profiles leave it. Larger catalogues are read in
    parts of that size, whose best are merged by record; the texts are then written once. An empty catalogue finds the generic profile.
    """
    table = as_table(cv.sparkSession, profiles)
    parts = list(_parts(_reduced(table) if title_scores is None else table))
    texts = _texts(cv, title_scores).withColumn("row", F.monotonically_increasing_id())
    texts = persisted(texts, "texts") if len(parts) > 1 else texts
    tops = []
    for part in parts:
        def run(batches, part=part):
            import pyarrow as pa

            catalogue = _Catalogue(part.value)
            kind = pa.list_(pa.struct([("neg", pa.float64()), ("ord", pa.int64()), ("id", pa.string()), ("sector", pa.string()), ("job_title", pa.string())]))
            for b in _slices(batches):
                top = [[{"neg": -score, "ord": (r := catalogue.rows[i])["ord"], "id": r["profile_id"], "sector": r["sector"], "job_title": r["job_title"]}
                        for score, i in catalogue.best(sk, ex, titles)] for sk, ex, titles in zip(b["sk"], b["ex"], b["titles"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(b["doc_id"], pa.int64()), pa.array(b["row"], pa.int64()), pa.array(top, kind)], names=["doc_id", "row", "top"])

        tops.append(texts.mapInArrow(run, f"doc_id long, row long, top {_TOP}"))
    found = tops[0]
    if len(tops) > 1:
        for more in tops[1:]:
            found = found.unionByName(more)
        found = found.groupBy("doc_id", "row").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, BEST).alias("top"))
    return found.select("doc_id", chosen(F.col("top")).alias("d")).select("doc_id", "d.*")


def forced(chosen: Column, profiles: Sequence[Profile]) -> Column:
    """Manual choice: confidence 1, generic for an unknown id."""
    out = F.struct(F.lit(lx.GENERIC_PROFILE_ID).alias("profile_id"), F.lit(lx.GENERIC_SECTOR).alias("sector"),
                   F.lit(lx.GENERIC_TITLE).alias("job_title"), F.lit(1.0).alias("confidence"))
    for p in profiles:
        out = F.when(chosen == p.profile_id, F.struct(F.lit(p.profile_id).alias("profile_id"), F.lit(p.sector).alias("sector"),
                     F.lit(p.job_title).alias("job_title"), F.lit(1.0).alias("confidence"))).otherwise(out)
    return out

"""Listing search and ranking for many records at once.

Records never meet every listing.  Equal searches (query, area) are answered once, each
answer is cut to the page size the search asks for, and only those listings are scored.
Records that ask the same are shown the same: what they are shown is found once, with its
keywords and vectors, and pairs of a record and a listing exist only when they are scored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions import contact, search
from sparkfolio.functions import text as tx
from sparkfolio.functions.arrays import int_range, sealed
from sparkfolio.functions.embedding import hashed_embedding
from sparkfolio.operators import keywords as kw
from sparkfolio.operators import semantic as sm
from sparkfolio.operators.nearby import within
from sparkfolio.session import persisted, repeated_apart, small_or_shuffled
from sparkfolio.sources.listings import source_order
from sparkfolio.sources.vector_store import VectorStore

MIN_SCORE = 25.0
FEW_RESULTS = 3
TOWN, UNMEASURED = "@", "?"  # keys of a town with coordinates, and of listings without any
SEARCHED = ("title", "description")


def asking(cv: DataFrame, max_results: int = 20, region: Column | None = None) -> DataFrame:
    """The records of ``cv`` that search, with ``ask``: their queries in order, place, distance and the page each search gets.

    Records without place or query make no search.
    """
    region = region if region is not None else F.lit(None).cast("string")
    base = sealed(cv.withColumn("_q", search.query_variants(F.col("job_title"), F.col("skills_flat"), F.col("sector")))
                  .withColumn("_p", search.search_place(region, F.col("postal_code"), F.col("location"))))
    page = F.greatest(F.lit(5), F.floor(F.lit(max_results) / F.size("_q"))).cast("int")
    ask = F.struct(F.transform("_q", F.lower).alias("queries"), F.col("_p.place").alias("place"), F.col("_p.distance").alias("distance"), page.alias("page"))
    return base.filter((F.size("_q") > 0) & F.col("_p.place").isNotNull()).withColumn("ask", ask).drop("_q", "_p")


def searches_of(asks: DataFrame) -> DataFrame:
    """(doc_id, query_ord, query, place, distance, area, page) for every search of ``asks`` (doc_id, ask)."""
    return (asks.select("doc_id", "ask", F.posexplode("ask.queries").alias("query_ord", "query"))
            .select("doc_id", "query_ord", "query", F.col("ask.place").alias("place"), F.col("ask.distance").alias("distance"),
                    search.search_area(F.col("ask.place")).alias("area"), F.col("ask.page").alias("page")))


def search_table(cv: DataFrame, max_results: int = 20, region: Column | None = None) -> DataFrame:
    """(doc_id, query_ord, query, place, distance, area, page) for every search of every record; see ``asking``."""
    rows = cv.select("doc_id", "job_title", "skills_flat", "sector", "postal_code", "location", *([region.alias("_region")] if region is not None else []))
    return searches_of(asking(rows, max_results, F.col("_region") if region is not None else None).select("doc_id", "ask"))


def towns_named(texts: DataFrame, places: DataFrame) -> DataFrame:
    """(text, town): the towns of ``places`` (id, name, department, lat, lon; name in lower case without accents) that place texts name. A
    department on both sides must be the same."""
    named = texts.select("text", F.explode(search.place_names(F.col("text"))).alias("name"), contact.department_code(F.col("text")).alias("own"))
    same = (named.name == places.name) & (F.col("own").isNull() | F.col("department").isNull() | (F.col("own") == F.col("department")))
    return named.join(places, same).select("text", F.col("id").cast("string").alias("town")).distinct()


def listing_keys(listings: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(text, at): the keys of each distinct location, null as empty: what ``listing_area`` says, and with ``places`` its towns, or where none has
    coordinates the same keys marked as unmeasured."""
    texts = listings.select(F.coalesce("location", F.lit("")).alias("text")).distinct()
    plain = texts.select("text", F.explode(search.listing_area(F.col("text"))).alias("at"))
    if places is None:
        return plain
    towns = towns_named(texts, places).select("text", F.concat(F.lit(TOWN), "town").alias("at"))
    rest = plain.join(towns.select("text").distinct(), "text", "left_anti").select("text", F.concat(F.lit(UNMEASURED), "at").alias("at"))
    return plain.unionByName(towns).unionByName(rest)


def place_keys(areas: DataFrame, keys: DataFrame, places: DataFrame | None = None, km: float = search.CV_RADIUS_KM) -> DataFrame:
    """(area, at): the listing keys (of ``listing_keys``) each distinct ``area`` meets.  An area that is no department or region, and whose
    names stand in no listing, cannot be placed and meets the whole country.  An area with towns meets the towns within ``km`` of them, and
    listings that cannot be measured by its other keys."""
    plain = areas.filter(~F.exists("area", lambda x: x.startswith(TOWN)))
    asked = plain.select("area", F.explode(search.asked_keys(F.col("area"))).alias("at"))
    known = keys.select("at").distinct().withColumn("known", F.lit(True))
    unplaced = (asked.join(known, "at", "left").groupBy("area").agg(F.coalesce(F.bool_or("known"), F.lit(False)).alias("known"))
                .filter(~F.col("known") & ~F.exists("area", search.is_department)).select("area", F.lit(search.NATIONWIDE).alias("at")))
    out = asked.unionByName(unplaced)
    if places is None:
        return out
    is_town = lambda x: x.startswith(TOWN)
    round_towns = areas.filter(F.exists("area", is_town))
    point = places.select(F.concat(F.lit(TOWN), F.col("id").cast("string")).alias("id"), "lat", "lon")
    asking = round_towns.select("area", F.explode(F.filter("area", is_town)).alias("town"))
    standing = point.join(keys.select(F.col("at").alias("id")).distinct(), "id", "left_semi")
    near = within(point.join(asking.select(F.col("town").alias("id")).distinct(), "id", "left_semi"), standing, km)
    towns = asking.join(near, asking.town == near.left_id).select("area", F.col("right_id").alias("at"))
    rest = round_towns.select("area", F.explode(search.asked_keys(F.filter("area", lambda x: ~is_town(x)))).alias("at"))
    return out.unionByName(towns).unionByName(rest.select("area", F.concat(F.lit(UNMEASURED), "at").alias("at"))).distinct()


def settled(searches: DataFrame, listings: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """``searches`` with one ``area`` for all that ask the same: places that cannot be placed become the whole country, so that they are
    answered once, and with ``places`` a search that has a distance gets the towns it names."""
    asked = searches.select("place", "distance", "area").distinct()
    if places is not None:
        towns = towns_named(asked.filter("distance is not null").select(F.col("place").alias("text")).distinct(), places)
        towns = towns.groupBy(F.col("text").alias("place")).agg(F.sort_array(F.collect_set(F.concat(F.lit(TOWN), "town"))).alias("towns"))
        asked = asked.join(towns, "place", "left").withColumn("spot", F.when(F.col("towns").isNotNull() & F.col("distance").isNotNull(), F.concat("towns", "area"))
                                                              .otherwise(F.col("area"))).drop("towns")
    else:
        asked = asked.withColumn("spot", F.col("area"))
    everywhere = place_keys(asked.select(F.col("spot").alias("area")).distinct(), listing_keys(listings)).filter(
        (F.col("at") == search.NATIONWIDE)).select(F.col("area").alias("spot")).distinct().withColumn("all", F.lit(True))
    asked = asked.join(everywhere, "spot", "left").select("place", "distance", F.when(F.col("all"), F.array(F.lit(search.NATIONWIDE))).otherwise(F.col("spot")).alias("spot"))
    other = asked.select(F.col("place").alias("_p"), F.col("distance").alias("_d"), "spot")
    return (searches.join(other, (F.col("place") == F.col("_p")) & F.col("distance").eqNullSafe(F.col("_d")))
            .select(*(F.col("spot").alias("area") if c == "area" else F.col(c) for c in searches.columns)))


def answer_searches(searches: DataFrame, listings: DataFrame, max_results: int = 20, fields: tuple[str, ...] = SEARCHED,
                    places: DataFrame | None = None) -> DataFrame:
    """(query, area, source, listing_id, r): each source's first listings of which one of ``fields`` holds the query phrase.

    Titles come before descriptions.  Fields become phrases of as many words as some search has (a job over the searches finds those few
    numbers), so one long search adds its own length only; those that are asked for meet the distinct searches by equality of phrase and place
    key; ``row_number`` with a bound lets Spark drop surplus rows in each task before the shuffle, so a query asked for by a third of all
    records, or a title shared by a third of all listings, stays bounded.  Fields that listings lack as columns are passed over.
    """
    queries = searches.select("query", "area").distinct()
    wanted = small_or_shuffled(queries.select("query").distinct())  # else every phrase of every listing is shuffled
    lengths = sorted(r.n for r in queries.select((F.floor(F.size(tx.text_parts(F.col("query"))) / 2) + 1).alias("n")).distinct().collect())
    keys = persisted(listing_keys(listings, places), "keys")  # a row for each distinct location and key
    asked = queries.join(place_keys(queries.select("area").distinct(), keys, places), "area")

    def grams(c):
        return F.array_distinct(tx.word_grams(tx.text_parts(F.coalesce(c, F.lit(""))), lengths=lengths))

    text, phrases = F.coalesce("location", F.lit("")).alias("text"), None
    for part, field in enumerate(f for f in fields if f in listings.columns and lengths):
        more = listings.select("listing_id", "source", text, F.explode(grams(F.col(field))).alias("query"), F.lit(part).alias("part"))
        phrases = more if phrases is None else phrases.unionByName(more)
    if phrases is None:
        phrases = listings.select("listing_id", "source", text, F.lit("").alias("query"), F.lit(0).alias("part")).limit(0)
    held = phrases.join(wanted, "query", "left_semi").join(keys, "text")
    found = held.join(asked, ["query", "at"]).groupBy("query", "area", "source", "listing_id").agg(F.min("part").alias("part"))
    order = Window.partitionBy("query", "area", "source").orderBy("part", "listing_id")
    return (found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= max_results)
            .select("query", "area", "source", "listing_id", "r"))


def candidates(searches: DataFrame, answers: DataFrame, listings: DataFrame) -> DataFrame:
    """(doc_id, listing_id, url, source, query_ord, source_ord, r): every listing shown to a record, repeats kept."""
    shown = searches.join(answers, ["query", "area"]).filter(F.col("r") <= F.col("page")).select("doc_id", "listing_id", "query_ord", "r")
    return shown.join(listings.select("listing_id", "url", "source", source_order(F.col("source")).alias("source_ord")), "listing_id")


def first_shown(cands: DataFrame) -> DataFrame:
    """First listing per record and URL, with how often listings were shown."""
    return cands.groupBy("doc_id", "url").agg(
        F.min_by(F.struct("listing_id", "source", "query_ord", "source_ord", "r"), F.struct("query_ord", "source_ord", "r", "listing_id")).alias("f"),
        F.count("*").alias("shown")).select("doc_id", "url", "f.*", "shown")


def score_candidates(cv: DataFrame, first: DataFrame, listings: DataFrame,
                     semantic: DataFrame | None = None) -> DataFrame:
    """(doc_id, listing_id, source, seen_ord, keyword, structure, semantic, overall, shown, matched, missing).

    Keywords are taken once for each listing that is shown.  A record's candidates (bounded by the page size) travel
    to the record in one array, so its text moves once.  ``semantic`` is an optional
    (doc_id, listing_id, semantic) frame; without it the semantic part is 0.
    """
    if semantic is not None:
        first = first.join(semantic, ["doc_id", "listing_id"], "left")
    else:
        first = first.withColumn("semantic", F.lit(0.0))
    shown = listings.select("listing_id", "description").join(first.select("listing_id").distinct(), "listing_id", "left_semi")
    jd = kw.with_top_keywords(shown, "description", "keywords", 40)
    packed = (first.join(jd.select("listing_id", "keywords"), "listing_id").groupBy("doc_id").agg(
        F.collect_list(F.struct("listing_id", "source", "query_ord", "source_ord", "r", "shown", "keywords",
                                F.coalesce("semantic", F.lit(0.0)).alias("semantic"))).alias("c")))
    structure = F.col("structure") if "structure" in cv.columns else kw.structure_score(F.col("sections"), F.col("skills_flat"))
    rec = cv.select("doc_id", F.lower("raw_text").alias("low"), structure.alias("structure"))
    # A keyword that several candidates share is looked for once, and the text does not leave its row.
    words = F.array_distinct(F.flatten(F.transform("c", lambda x: x["keywords"])))
    rows = sealed(packed.join(rec, "doc_id").select("doc_id", "structure", "c", kw.matched(words, F.col("low")).alias("found")))
    rows = rows.select("doc_id", "structure", "found", F.explode("c").alias("x"))
    return _scores(sealed(rows.select("doc_id", "structure", "x", F.col("x.semantic").alias("semantic"), F.array_intersect("x.keywords", "found").alias("hit"))))


def _scores(rows: DataFrame) -> DataFrame:
    """Scores of (doc_id, structure, x, semantic, hit): x a listing shown, hit those of its keywords that the record holds."""
    n = F.size("x.keywords")
    keyword = F.when(n > 0, F.size("hit") / n).otherwise(0.5)
    return rows.select(
        "doc_id", F.col("x.listing_id").alias("listing_id"), F.col("x.source").alias("source"),
        F.struct("x.query_ord", "x.source_ord", "x.r").alias("seen_ord"), F.col("x.shown").alias("shown"),
        keyword.alias("keyword"), "structure", "semantic",
        kw.overall_score(F.col("semantic"), keyword, F.col("structure")).alias("overall"),
        F.slice("hit", 1, 20).alias("matched"),
        F.slice(F.array_except("x.keywords", "hit"), 1, 20).alias("missing"))


def rank_matches(scored: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Add rank (score descending, first shown first) and keep scores of at least ``min_score``,
    or everything for a record where none passes."""
    w = Window.partitionBy("doc_id")
    order = w.orderBy(F.desc("overall"), "seen_ord")
    return (scored.withColumn("rank", F.row_number().over(order))
            .withColumn("any_passed", F.max(F.col("overall") >= min_score).over(w))
            .filter((F.col("overall") >= min_score) | ~F.col("any_passed")).drop("any_passed"))


def top_matches(ranked: DataFrame, n: int = 10) -> DataFrame:
    return ranked.filter(F.col("rank") <= n)


def match_summary(scored: DataFrame, ranked: DataFrame) -> DataFrame:
    """(doc_id, matches, few_results, duplicates_removed, source_counts)."""
    seen = scored.groupBy("doc_id").agg(
        (F.sum("shown") - F.count("*")).alias("duplicates_removed"),
        ((F.count("*") > 0) & (F.count_if(F.col("overall") >= MIN_SCORE) < FEW_RESULTS)).alias("few_results"))
    per_source = ranked.groupBy("doc_id", "source").agg(F.count("*").alias("n"))
    counts = per_source.groupBy("doc_id").agg(
        F.sum("n").alias("matches"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("source", "n")))).alias("source_counts"))
    return seen.join(counts, "doc_id")


def needed_of(cv: DataFrame, region: Column | None = None) -> DataFrame:
    """What matching reads of a record, with its structure score and the region it searches: a record's long expressions are evaluated once."""
    region = region if region is not None else F.lit(None).cast("string")
    return cv.select("doc_id", "job_title", "skills_flat", "sector", "postal_code", "location", "raw_text",
                     kw.structure_score(F.col("sections"), F.col("skills_flat")).alias("structure"), region.alias("region"))


MAX_WORDS = 1_000_000  # keywords that are broadcast, some 20 MB


def _broadcast_below(df: DataFrame, words: str) -> DataFrame:
    """Broadcast hint only while the lists of ``words`` have few words in all; otherwise the planner decides."""
    return F.broadcast(df) if (df.agg(F.sum(F.size(words))).first()[0] or 0) <= MAX_WORDS else df


def shown_lists(first: DataFrame, listings: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """(ask, c, words): for each ``doc_id`` of ``first`` its listings with keywords and vector, and the distinct keywords of all of them."""
    jobs = kw.with_top_keywords(listings, "description", "keywords", 40)
    if vectors is not None:
        jobs = jobs.join(vectors.select(F.col("key").alias("_key"), "vector"), sm.text_id(F.col("description")) == F.col("_key"), "left")
    else:
        jobs = jobs.withColumn("vector", F.lit(None).cast("array<float>"))
    packed = (first.join(jobs.select("listing_id", "keywords", "vector"), "listing_id").groupBy(F.col("doc_id").alias("ask_id")).agg(
        F.collect_list(F.struct("listing_id", "source", "query_ord", "source_ord", "r", "shown", "keywords", "vector")).alias("c")))
    return packed.withColumn("words", F.array_distinct(F.flatten(F.transform("c", lambda x: x["keywords"]))))


def scored_candidates(cv: DataFrame, listings: DataFrame, max_results: int = 20, region: Column | None = None, fields: tuple[str, ...] = SEARCHED,
                      semantic: DataFrame | None = None, embed: sm.Embed | None = hashed_embedding, store: VectorStore | None = None,
                      places: DataFrame | None = None) -> DataFrame:
    """Scores of the listings that each record's searches show.  The semantic part comes from ``semantic``, or else from texts embedded by
    ``embed`` (each distinct one once, kept in ``store``); with neither it is 0.

    What is needed of the records is written once; they are answered by what they ask, which many have in common. Records that share an id, and
    records with a given ``semantic``, are answered and scored pair by pair. A null id has no pairs.
    """
    needed = asking(needed_of(cv.filter("doc_id is not null"), region), max_results, F.col("region"))
    records = persisted(needed.select("doc_id", "raw_text", "structure", "ask", F.md5(F.to_json("ask").cast("binary")).alias("ask_id"),
                                      sm.text_id(F.col("raw_text")).alias("key")), "records")
    alone, several = repeated_apart(records, "doc_id")
    answered = lambda asks: _answered(asks, listings, max_results, fields, places)
    if semantic is not None:
        return score_candidates(records, answered(records)[0], listings, semantic)
    scored = _scored_by_ask(alone, *answered(alone.select(F.col("ask_id").alias("doc_id"), "ask").distinct()), embed, store)
    if several.isEmpty():
        return scored
    first, listed = answered(several)
    pairs = sm.pair_similarity(first, several, listed, embed, store=store) if embed is not None else None
    return scored.unionByName(score_candidates(several, first, listed, pairs))


def _answered(asks: DataFrame, listings: DataFrame, max_results: int, fields: tuple[str, ...], places: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What ``asks`` (doc_id, ask) are shown, as of ``first_shown``, and the listings shown."""
    searches = persisted(settled(persisted(searches_of(asks), "searches"), listings, places), "settled")
    answers = persisted(answer_searches(searches, listings, max_results, fields, places), "answers")
    listed = persisted(listings.join(small_or_shuffled(answers.select("listing_id").distinct()), "listing_id", "left_semi")
                       .select("listing_id", "url", "source", "description"), "listed")
    return persisted(first_shown(candidates(searches, answers, listed)), "shown"), listed


def _scored_by_ask(records: DataFrame, first: DataFrame, listed: DataFrame, embed: sm.Embed | None, store: VectorStore | None) -> DataFrame:
    """Scores of ``records`` with what their ``ask_id`` is shown. A text meets the keywords of what its record is shown, then stays behind: the record
    goes on with the places of the keywords it holds, and meets keywords and vectors of the listings again where it is scored."""
    vectors = None
    if embed is not None:
        texts = records.join(small_or_shuffled(first.select(F.col("doc_id").alias("ask_id")).distinct()), "ask_id", "left_semi").select("key", F.col("raw_text").alias("text"))
        jobs = listed.join(small_or_shuffled(first.select("listing_id").distinct()), "listing_id", "left_semi")
        vectors = sm.vectors_of(texts.unionByName(jobs.select(sm.text_id(F.col("description")).alias("key"), F.col("description").alias("text"))), embed, store=store)
    lists = persisted(shown_lists(first, listed, vectors), "lists")
    low = records.select("doc_id", "ask_id", "structure", "key", F.lower("raw_text").alias("low"))
    met = low.join(_broadcast_below(lists.select("ask_id", "words"), "words"), "ask_id")
    # A keyword that several candidates share is looked for once.
    at = F.filter(int_range(F.lit(0), F.size("words") - 1), lambda i: F.contains("low", F.get("words", i)))
    rows = met.select("doc_id", "ask_id", "structure", "key", at.alias("at"))
    own = F.lit(None).cast("array<float>") if vectors is None else F.col("vector")
    if vectors is not None:
        rows = rows.join(vectors, "key", "left")
    rows = rows.select("doc_id", "ask_id", "structure", "at", own.alias("own")).join(lists, "ask_id")
    rows = rows.select("doc_id", "structure", "own", F.transform("at", lambda i: F.get("words", i)).alias("found"), F.explode("c").alias("x"))
    return _scores(sealed(rows.select("doc_id", "structure", "x", sm.likeness(F.col("own"), F.col("x.vector")).alias("semantic"),
                                      F.array_intersect("x.keywords", "found").alias("hit"))))


def find_matching_jobs(cv: DataFrame, listings: DataFrame, max_results: int = 20, region: Column | None = None,
                       active: list[str] | None = None, semantic: DataFrame | None = None,
                       fields: tuple[str, ...] = SEARCHED, embed: sm.Embed | None = hashed_embedding, store: VectorStore | None = None,
                       places: DataFrame | None = None) -> DataFrame:
    """Ranked matches of every record against a listing table.

    ``listings`` needs listing_id, title, location, description, url, source.  ``places`` (id, name, department, lat, lon) gives towns
    coordinates: a record's own town then finds the listings within 30 km, in whatever department.  Without it, or for towns it lacks, departments
    and names decide.
    """
    if active is not None:
        listings = listings.filter(F.col("source").isin(*active))
    return rank_matches(scored_candidates(cv, listings, max_results, region, fields, semantic, embed, store, places))


def match_report(cv: DataFrame, listings: DataFrame, max_results: int = 20, fields: tuple[str, ...] = SEARCHED, embed: sm.Embed | None = hashed_embedding,
                 store: VectorStore | None = None, places: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scored, ranked, summary); the scored pairs are written once and read by the other two."""
    scored = persisted(scored_candidates(cv, listings, max_results, None, fields, None, embed, store, places), "scored")
    ranked = rank_matches(scored)
    return scored, ranked, match_summary(scored, ranked)

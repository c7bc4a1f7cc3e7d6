"""Semantic similarity from text to text: each distinct text is embedded once, and only given pairs are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions import text as tx
from sparkfolio.functions.arrays import int_range, let
from sparkfolio.functions.embedding import hashed_embedding
from sparkfolio.functions.vectors import dot
from sparkfolio.operators import vectorjoin as vj
from sparkfolio.session import persisted, repeated_apart
from sparkfolio.sources.vector_store import VectorStore

MAX_WORDS = 256  # of a piece that a model sees at once
Embed = Callable[[DataFrame, str, str], DataFrame]  # (rows, text column, new column) -> rows with a vector


def text_id(text: Column) -> Column:
    """Content hash that names a text; null for null."""
    return F.md5(text.cast("binary"))


def pieces(text: Column, max_words: int = MAX_WORDS) -> Column:
    """array<struct<piece, n>>: the words of a text, ``max_words`` at a time; none of it is left out."""
    def cut(w):
        starts = F.transform(int_range(F.lit(0), F.ceil(F.size(w) / max_words).cast("int") - 1), lambda i: i * max_words + 1)
        return F.transform(starts, lambda s: let(F.slice(w, s, max_words), lambda p: F.struct(F.array_join(p, " ").alias("piece"), F.size(p).alias("n"))))

    return let(tx.words(F.coalesce(text, F.lit(""))), cut)


def embed_texts(texts: DataFrame, embed: Embed = hashed_embedding, max_words: int = MAX_WORDS) -> DataFrame:
    """(key, vector) for (key, text): the unit mean of the vectors of a text's pieces, weighted by their words.

    A text without words, or whose mean is zero, has an empty vector, which is like nothing. Pieces are embedded as rows, so that a model sees full
    batches; a text's few vectors meet again in one row.
    """
    parts = texts.select("key", F.posexplode_outer(pieces(F.col("text"), max_words)).alias("at", "p")).select("key", "at", "p.piece", "p.n")
    some = embed(parts.filter("piece is not null"), "piece", "v").select("key", "at", "n", "v")
    held = some.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("at", "n", "v"))).alias("vs"))

    def mean(vs):
        weighted = F.transform(vs, lambda x: F.transform(x["v"], lambda y: y.cast("double") * x["n"]))
        first = F.get(weighted, F.lit(0))
        return F.aggregate(F.slice(weighted, 2, F.size(weighted)), first, lambda a, b: F.zip_with(a, b, lambda x, y: x + y))

    summed = held.select("key", mean(F.col("vs")).alias("m"))
    size = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    unit = summed.select("key", "m", size.alias("size")).select("key", F.when(F.col("size") > 0, F.transform("m", lambda x: x / F.col("size"))).otherwise(
        F.array().cast("array<double>")).cast("array<float>").alias("vector"))
    none = parts.filter("piece is null").select("key", F.array().cast("array<float>").alias("vector"))
    return unit.unionByName(none)


def vectors_of(texts: DataFrame, embed: Embed = hashed_embedding, max_words: int = MAX_WORDS, store: VectorStore | None = None) -> DataFrame:
    """(key, vector) of the distinct texts of ``texts`` (key, text), from ``store`` where it has them; what it lacks is added to it. Without a
    store the vectors are written to the shared folder once, so that no reader embeds a text again; only texts that repeat are shuffled."""
    if store is None:
        alone, several = repeated_apart(texts.filter("key is not null"), "key")
        return persisted(embed_texts(alone.unionByName(several.dropDuplicates(["key"])), embed, max_words), "vectors")
    store.ensure(texts, lambda lacking: embed_texts(lacking, embed, max_words))
    return store.read()


def _dot(a: Column, b: Column) -> Column:
    """Dot product of a row's vectors, where they stand: pairs are many and their vectors long, so none goes to Python. 0 where one is null or their
    lengths differ."""
    return F.when(F.size(a) == F.size(b), dot(a, b)).otherwise(F.lit(0.0))


def likeness(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors, clipped to [0, 1]."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), _dot(a, b)))


def pair_similarity(pairs: DataFrame, cv: DataFrame, listings: DataFrame, embed: Embed = hashed_embedding, max_words: int = MAX_WORDS,
                    store: VectorStore | None = None, text: str = "raw_text", description: str = "description") -> DataFrame:
    """(doc_id, listing_id, semantic) of ``pairs`` (doc_id, listing_id): cosine of record and description, clipped to [0, 1].

    Only texts of a pair are embedded, each distinct one once. A pair carries text keys until it meets the vectors: that of the listing first,
    then that of the record. Null and empty texts are like nothing: 0.
    """
    pairs = pairs.select("doc_id", "listing_id").distinct()
    docs = cv.select("doc_id", F.col(text).alias("text")).join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("key", text_id(F.col("text")))
    jobs = (listings.select("listing_id", F.col(description).alias("text")).join(pairs.select("listing_id").distinct(), "listing_id", "left_semi")
            .withColumn("key", text_id(F.col("text"))))
    vectors = vectors_of(docs.select("key", "text").unionByName(jobs.select("key", "text")), embed, max_words, store)
    keyed = pairs.join(jobs.select("listing_id", F.col("key").alias("job_key")), "listing_id").join(docs.select("doc_id", F.col("key").alias("doc_key")), "doc_id")
    met = (keyed.join(vectors.select(F.col("key").alias("job_key"), F.col("vector").alias("b")), "job_key", "left")
           .join(vectors.select(F.col("key").alias("doc_key"), F.col("vector").alias("a")), "doc_key", "left"))
    return met.select("doc_id", "listing_id", likeness(F.col("a"), F.col("b")).alias("semantic"))


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 2) -> DataFrame:
    """(owner, at, line): the stripped lines of each text that have at least ``min_words`` words."""
    lines = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|[\n\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"), tx.strip)
    rows = docs.select(F.col(key).alias("owner"), F.posexplode(lines).alias("at", "line"))
    return rows.filter(tx.word_count(F.col("line")) >= min_words)


def semantic_skills_from_text(docs: DataFrame, phrases: DataFrame, threshold: float = 0.51, embed: Embed = hashed_embedding, key: str = "doc_id", text: str = "text",
                              store: VectorStore | None = None, max_broadcast: int = vj.MAX_BROADCAST) -> DataFrame:
    """(owner, phrase, sim): the phrases whose best line in a text reaches ``threshold``.

    ``phrases`` is (phrase long, text). Their vectors come from ``store`` where it has them. Lines of two words or more are embedded where they stand,
    compared in the task and leave it as hits only, so that no pair of line and phrase is shuffled; a phrase set above the bound is
    met through its index. Texts without such lines have no rows; owners are whole numbers, not null.
    """
    keyed = phrases.select("phrase", F.col("text"), text_id(F.col("text")).alias("key"))
    vectors = keyed.join(vectors_of(keyed.select("key", "text"), embed, store=store), "key").filter(F.size("vector") > 0).select("phrase", "vector")
    lines = embed(lines_of(docs.filter(F.col(key).isNotNull()), key, text), "line", "vector").select("owner", "vector")
    return vj.hits_per_phrase(lines, vectors, threshold, max_broadcast)

"""Registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import backoff, licenses, media, merkle, mixing, pieces, piecewise, rules, runs, setjoin, suffixes, toxicity, vectors
from sparkfolio.llm.training import labelled_sample, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text as a P6 image, decoded, hashed and written as NPY tiles; the payload is read back from the tiles."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    stored = media.media_from_text(docs).select("doc_id", "n_bytes", "media")
    return media.payload_digests(stored, keep=("doc_id", "n_bytes"))


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_digest(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", remainder(F.col("doc_id"), 3) != 1, bound=8_000)
    scored = toxicity.with_toxicity(docs, toxicity.fit_toxicity(sample))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sample = labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", remainder(F.col("doc_id"), 5) != 0)
    model = rules.fit_quality(sample)
    scored = rules.with_stats(docs.select("doc_id", "text")).select("doc_id", model.score_column().alias("score"))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.from_model(piece_model())
    return pieces.token_digests(table(spark, sf_dir, "documents"), vocabulary)


@query
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents"))


# Shares of tokens that the mixed corpus should have: no listed source alone more than another, English half. Other sources and
# languages, and nulls, keep the shares they have.
MIX_TARGETS = {
    "source": {**{f"src{i}": 0.05 for i in range(20)}},
    "lang": {"en": 0.5, "de": 0.2, "fr": 0.17, "es": 0.13},
    "topic": {"prose": 0.86, "legal": 0.03, "contact": 0.06, "table": 0.03, "code": 0.01, "*": 0.01},
}
MIX_KEEP = 0.4  # of all tokens


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, lang, source) with topic, weight, probability and decision; the larger helper of two callers."""
    own = docs.withColumn("topic", mixing.topic_of(F.col("text")))
    mix = mixing.fit_mix(own, MIX_TARGETS, mixing.token_count(F.col("text")), MIX_KEEP)
    return mixing.with_mix(own, mix, MIX_TARGETS, F.col("doc_id"), seed=6)


@query
def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")).select(
        "doc_id", "source", "lang", "topic", "mix_weight", "mix_probability", "mix_kept")


@query
def op7_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 7) == 2
    return (backoff.lm_scores(table(spark, sf_dir, "documents"), ~held_out)
            .select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))


@query
def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"))


def id_hash(doc_id: Column) -> Column:
    """Unsigned crc32 of the id in decimal; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.with_runs(table(spark, sf_dir, "documents"), mark=id_hash(F.col("doc_id")), outputs=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.document_manifest(table(spark, sf_dir, "documents"), id_hash(F.col("doc_id")) % 2 == 0)


_VALUE = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || {0} END"
_HEAD = " || ".join(_VALUE.format(c) for c in merkle.FIELDS[:-1])
# crc32, bit by bit, of the id in decimal: eight steps a byte, of which the first takes the byte in.
_CRC = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: [CAST(ascii(substr(CAST(doc_id AS VARCHAR), i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, b: xor(xor(c, b) >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"""
ORACLES["op12_merkle_manifest"] = f"""
WITH RECURSIVE digests AS (
  SELECT doc_id, source, sha256({_HEAD} || {_VALUE.format("text")}) AS leaf,
    CASE WHEN ({_CRC}) % 2 = 0 THEN sha256({_HEAD} || {_VALUE.format("replace(text, chr(10), '')")}) END AS tampered FROM documents),
leaves AS (
  SELECT *, row_number() OVER () AS rid, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS size,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM digests),
up AS (
  SELECT 0 AS depth, tree, pos, size, leaf AS digest FROM leaves UNION ALL
  SELECT depth + 1, tree, pos // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM up WHERE size > 1 GROUP BY depth, tree, pos // 3, size),
tops AS (SELECT tree, digest FROM up WHERE size = 1),
high AS (
  SELECT 0 AS depth, tree AS pos, (SELECT count(*) FROM tops) AS size, digest FROM tops UNION ALL
  SELECT depth + 1, pos // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE size > 1 GROUP BY depth, pos // 3, size),
steps AS (
  SELECT l.rid, u.depth AS k, string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos < l.pos // CAST(pow(3, u.depth) AS BIGINT)) AS before,
    string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos > l.pos // CAST(pow(3, u.depth) AS BIGINT)) AS after
  FROM leaves l JOIN up u ON u.tree = l.tree AND u.size > 1 AND u.pos // 3 = l.pos // CAST(pow(3, u.depth + 1) AS BIGINT) GROUP BY ALL
  UNION ALL
  SELECT l.rid, 1000 + u.depth, string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos < l.tree // CAST(pow(3, u.depth) AS BIGINT)),
    string_agg(u.digest, '' ORDER BY u.pos) FILTER (u.pos > l.tree // CAST(pow(3, u.depth) AS BIGINT))
  FROM leaves l JOIN high u ON u.size > 1 AND u.pos // 3 = l.tree // CAST(pow(3, u.depth + 1) AS BIGINT) GROUP BY ALL),
path AS (SELECT rid, row_number() OVER (PARTITION BY rid ORDER BY k) AS n, coalesce(before, '') AS before, coalesce(after, '') AS after FROM steps),
fold AS (
  SELECT rid, CAST(0 AS BIGINT) AS n, coalesce(tampered, leaf) AS own FROM leaves UNION ALL
  SELECT fold.rid, path.n, sha256(path.before || fold.own || path.after) FROM fold JOIN path ON path.rid = fold.rid AND path.n = fold.n + 1),
last AS (SELECT rid, arg_max(own, n) AS folded_root FROM fold GROUP BY rid),
proof AS (SELECT rid, sha256(string_agg(before || after, '' ORDER BY n)) AS proof_sha256 FROM path GROUP BY rid)
SELECT l.doc_id, l.leaf, t.digest AS subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, f.folded_root,
  f.folded_root = r.digest AS verified
FROM leaves l JOIN tops t ON t.tree = l.tree CROSS JOIN (SELECT digest FROM high WHERE size = 1) r JOIN last f ON f.rid = l.rid LEFT JOIN proof p ON p.rid = l.rid
"""

@query
def op13_piecewise_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.edit_report(table(spark, sf_dir, "documents"))


ORACLES["op8_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE link.x = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = v.vec_id
"""

"""Exact similarity of many vectors with a set of phrase vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.session import persisted

MAX_BROADCAST = 8_192
BLOCK = 4_096
MAX_PIVOTS, PER_CELL, RINGS = 1_024, 256, 32
PAIR = "id long, phrase long, sim double"


def centroids(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """(label, vector): mean vector per label, averaged per position before anything is collected."""
    pos = vectors.select(F.col(label).alias("label"), F.posexplode(vector).alias("p", "v"))
    mean = pos.groupBy("label", "p").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return mean.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("p", "m"))), lambda x: x["m"]).alias("vector"))


def _unit(vectors) -> np.ndarray:
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, size, out=np.zeros_like(m), where=size > 0)


def _pairs(ids, vectors, phrase_ids, phrases, threshold) -> pd.DataFrame:
    sim = _unit(vectors) @ phrases.T
    i, j = np.nonzero(sim >= threshold)
    return pd.DataFrame({"id": np.asarray(ids)[i], "phrase": np.asarray(phrase_ids)[j], "sim": sim[i, j]})


def similar_pairs(vectors: DataFrame, phrases: DataFrame, threshold: float, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(id, phrase, sim) with cosine of at least ``threshold``.

    ``vectors`` is (id, vector), ``phrases`` is (phrase, vector).  Up to ``max_broadcast`` phrases
    are sent to every task as one matrix and nothing is shuffled.  A larger set becomes an index, see ``indexed_pairs``; same results.
    """
    head = _small(phrases, max_broadcast)
    if head is not None:
        if not len(head[0]):
            return vectors.sparkSession.createDataFrame([], PAIR)
        shared = vectors.sparkSession.sparkContext.broadcast(head)

        def run(batches):
            ids, matrix = shared.value
            for b in batches:
                if len(b):
                    yield _pairs(b["id"], b["vector"], ids, matrix, threshold)

        return vectors.select("id", "vector").mapInPandas(run, PAIR)
    return indexed_pairs(vectors, phrases, threshold)


def _pivots(phrases: DataFrame) -> np.ndarray:
    """Unit vectors of up to MAX_PIVOTS phrases, about one for each PER_CELL, taken by a hash of the phrase."""
    n = phrases.count()
    wanted = max(1, min(MAX_PIVOTS, n // PER_CELL))
    drawn = phrases.orderBy(F.xxhash64("phrase")).limit(wanted).toPandas()
    return _unit(drawn["vector"]) if len(drawn) else np.zeros((0, 0))


def indexed_pairs(vectors: DataFrame, phrases: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """As ``similar_pairs`` for phrase sets of any size, exactly, by pivots and rings.

    A phrase belongs to the ring of its distance around its nearest pivot. Unit vectors with a cosine of ``threshold`` are at most sqrt(2 - 2
    threshold) apart, so by the triangle inequality a vector can only meet rings whose distances to the pivot come that near to its own, and only
    these get a copy of it. Zero vectors have no direction: their cosine is 0 with everything, so they have pairs only where the threshold lets
    them, and then go to every ring. Rings with many phrases or vectors are cut into blocks. Pivots (MAX_PIVOTS at most) and the bounds of rings (RINGS for each
    pivot at most) are what tasks share.
    """
    spark = vectors.sparkSession
    pivots = _pivots(phrases)
    if not len(pivots):
        return spark.createDataFrame([], PAIR)
    radius = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9
    shared = spark.sparkContext.broadcast(pivots)

    def placed(batches):
        for b in batches:
            if len(b):
                m = _unit(b["vector"])
                far = np.sqrt(np.maximum(0, (m ** 2).sum(1)[:, None] + 1 - 2 * m @ shared.value.T))
                cell = far.argmin(1)
                near = far[np.arange(len(m)), cell]
                yield pd.DataFrame({"phrase": b["phrase"], "vector": list(m), "cell": cell, "ring": (near * RINGS / 2.0001).astype(int), "far": near})

    index = persisted(phrases.select("phrase", "vector").mapInPandas(placed, "phrase long, vector array<double>, cell int, ring int, far double"), "index")
    rings = index.groupBy("cell", "ring").agg(F.min("far").alias("low"), F.max("far").alias("high"), F.count(F.lit(1)).alias("n")).toPandas()
    bounds = spark.sparkContext.broadcast((rings["cell"].to_numpy(), rings["ring"].to_numpy(), rings["low"].to_numpy(), rings["high"].to_numpy()))

    def asking(batches):
        cell, ring, low, high = bounds.value
        for b in batches:
            for i in range(0, len(b), 1024):
                part = b.iloc[i:i + 1024]
                m = _unit(part["vector"])
                zero = ~m.any(1)
                far = np.sqrt(np.maximum(0, (m ** 2).sum(1)[:, None] + 1 - 2 * m @ shared.value.T))[:, cell]
                x, y = np.nonzero((far + radius >= low) & (far - radius <= high) & ~zero[:, None] | (zero[:, None] & (threshold <= 0)))
                yield pd.DataFrame({"id": part["id"].to_numpy()[x], "vector": list(m[x]), "cell": cell[y], "ring": ring[y]})

    asks = persisted(vectors.select("id", "vector").mapInPandas(asking, "id long, vector array<double>, cell int, ring int"), "asks")
    sizes = (asks.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("rows"))
             .join(index.groupBy("cell", "ring").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("columns")), ["cell", "ring"]))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = (asks.join(sizes, ["cell", "ring"]).select("cell", "ring", F.pmod(F.xxhash64("id", F.lit(1)), "rows").cast("int").alias("i"), every("columns").alias("j"), "id", "vector"))
    right = (index.join(sizes, ["cell", "ring"]).select("cell", "ring", every("rows").alias("i"), F.pmod(F.xxhash64("phrase", F.lit(2)), "columns").cast("int").alias("j"), "phrase", "vector"))

    def run(a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"id": pd.Series(dtype="int64"), "phrase": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
        return _pairs(a["id"], a["vector"], b["phrase"], _unit(b["vector"]), threshold)

    keys = ("cell", "ring", "i", "j")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, PAIR)


def _best_in_blocks(vectors: DataFrame, phrases: DataFrame, block: int = BLOCK) -> DataFrame:
    """(owner, phrase, sim): blocks of phrases meet blocks of vectors, and each block is reduced to its best before anything is shuffled on."""
    n_p, n_v = (max(1, -(-d.count() // block)) for d in (phrases, vectors))
    left = vectors.withColumn("i", F.pmod(F.xxhash64("owner", "vector"), F.lit(n_v)).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_p - 1))))
    right = phrases.withColumn("j", F.pmod(F.xxhash64("phrase"), F.lit(n_p)).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1))))

    def run(a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"owner": pd.Series(dtype="int64"), "phrase": pd.Series(dtype="int64"), "sim": pd.Series(dtype="float64")})
        return _best_of(a["owner"], a["vector"], b["phrase"].to_numpy(), _unit(b["vector"]))

    part = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(run, "owner long, phrase long, sim double")
    return part.groupBy("owner", "phrase").agg(F.max("sim").alias("sim"))


def _best_of(owners, vectors, ids, matrix) -> pd.DataFrame:
    best = pd.DataFrame(_unit(vectors) @ matrix.T, columns=ids).groupby(owners.to_numpy()).max()
    return best.rename_axis("owner").reset_index().melt("owner", var_name="phrase", value_name="sim").astype({"phrase": "int64"})


def best_per_phrase(vectors: DataFrame, phrases: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(owner, phrase, sim): best similarity over the vectors of each owner.

    ``vectors`` is (owner, vector).  Each batch is reduced to one row per owner and phrase before
    anything is shuffled, so the pairs themselves never leave a task.
    """
    head = _small(phrases, max_broadcast)
    owned = vectors.select(F.col("owner").cast("bigint").alias("owner"), "vector")
    if head is None:
        return _best_in_blocks(owned, phrases)
    shared = vectors.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        ids, matrix = shared.value
        for b in batches:
            if len(b):
                yield _best_of(b["owner"], b["vector"], ids, matrix)

    return owned.mapInPandas(run, "owner long, phrase long, sim double").groupBy("owner", "phrase").agg(F.max("sim").alias("sim"))


def hits_per_phrase(vectors: DataFrame, phrases: DataFrame, threshold: float, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(owner, phrase, sim) of ``best_per_phrase`` where it reaches ``threshold``: only hits leave a task, whatever the size of ``phrases``.

    ``vectors`` is (owner, vector)."""
    numbered = vectors.select(F.col("owner").cast("bigint").alias("id"), "vector")
    return similar_pairs(numbered, phrases, threshold, max_broadcast).groupBy(F.col("id").alias("owner"), "phrase").agg(F.max("sim").alias("sim"))


def similarity_maps(vectors: DataFrame, phrases: DataFrame) -> DataFrame:
    """(id, sims): one map phrase -> cosine per vector; phrases above the bound are refused."""
    head = _small(phrases, MAX_BROADCAST)
    if head is None:
        raise ValueError(f"more than {MAX_BROADCAST} phrases: use similar_pairs with a threshold")
    shared = vectors.sparkSession.sparkContext.broadcast(head)

    def run(batches):
        _ids, matrix = shared.value
        for b in batches:
            if len(b):
                yield pd.DataFrame({"id": b["id"], "s": list(_unit(b["vector"]) @ matrix.T)})

    keys = F.array(*[F.lit(int(i)).cast("bigint") for i in head[0]])
    return vectors.select("id", "vector").mapInPandas(run, "id long, s array<double>").select(
        "id", F.map_from_arrays(keys, "s").alias("sims"))


def _small(phrases: DataFrame, bound: int):
    """(ids, unit matrix) of a phrase set within the bound, else None."""
    head = phrases.orderBy("phrase").limit(bound + 1).toPandas()
    return (head["phrase"].to_numpy(), _unit(head["vector"])) if len(head) <= bound else None


def semantic_skills(best: DataFrame, threshold: float = 0.51) -> DataFrame:
    """(owner, phrases): phrases whose best line reaches the threshold, in phrase order."""
    return best.filter(F.col("sim") >= threshold).groupBy("owner").agg(F.sort_array(F.collect_list("phrase")).alias("phrases"))


def threshold_sweep(best: DataFrame, corpus, flagged, thresholds=(0.45, 0.50, 0.55, 0.60, 0.65, 0.70)) -> DataFrame:
    """(threshold, corpus, owners, avg_matches, false_positives) for every threshold."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    per = best.select("owner", "sim", t).groupBy("owner", "threshold").agg(F.count_if(F.col("sim") >= F.col("threshold")).alias("n"))
    return per.withColumn("corpus", corpus).groupBy("threshold", "corpus").agg(
        F.count("*").alias("owners"), F.round(F.avg("n"), 1).alias("avg_matches"),
        F.sum(F.when(flagged, F.col("n")).otherwise(0)).alias("false_positives"))


def cached_vectors(phrases: DataFrame, cache: DataFrame, recompute=None) -> DataFrame:
    """Phrases with the vectors the cache holds under the same phrase, and ``recompute`` of those it lacks. Without a
    ``recompute`` a lacking phrase is an error, found by a job that runs when this is called. Further cache rows are ignored."""
    once = cache.dropDuplicates(["phrase"])
    held, lacking = phrases.join(once, "phrase"), phrases.join(once, "phrase", "left_anti")
    if recompute is not None:
        return held.unionByName(recompute(lacking))
    if not lacking.isEmpty():
        raise ValueError("the vector cache lacks phrases and no recompute function is given")
    return held

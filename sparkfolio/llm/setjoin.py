"""Exact n-gram Jaccard join with set-relation skipping.

Two sets of word shingles link when 100 * intersection >= 80 * union. Documents with equal sets are one node. Nodes meet in index lists
of the shingles that open a set when the rarest come first (counts over the whole corpus order them). A list is cut into blocks by set
size, and a node skips the blocks that its place in the list's set rules out. Nodes that meet are compared with one leader first. The
others' answers are derived from the leader's: a set is the leader's less some shingles plus some, so an intersection follows from the
leader's and the few shingles in between; what the distance to the leader already excludes is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.corpus import batches_for, counted, dealt, keyed, released, summed
from sparkfolio.llm.graph import components
from sparkfolio.llm.textnum import U, ddl, mixed, release, shingles, slices, word_hashes
from sparkfolio.session import persisted

WORDS, PER_CENT = 5, 80
BLOCK = 256  # nodes of a large cluster that are compared at a time


def sets_of(col, k: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each row."""
    for i, j, h, first in word_hashes(col):
        out, at = shingles(h, first, k)
        for r in range(j - i):
            yield out[at[r]:at[r + 1]]


def set_hash(x: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        a = mixed(np.array([mixed(x).sum(dtype=U) * U(0x9E3779B97F4A7C15) + U(len(x))], U))
    return int(a.view(np.int64)[0])


def opening(n: int, per_cent: int = PER_CENT) -> int:
    """How many of a set's first shingles must hold one of any linked set's."""
    return n + (-per_cent * n // 100) + 1


def size_class(n):
    """Sizes of one class differ by at most the factor that links allow; linked sets are in the same or the next class."""
    return F.floor(F.log(n.cast("double")) / np.log(100 / PER_CENT) + 1e-12)


def document_sets(docs: DataFrame, id_col: str, text: str, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, _k0.. (the columns ``keep``), node (null without words), n, and for documents that may have a partner their opening shingles
    that others hold (token, place) and their text; written to the shared folder."""
    names = [f"_k{i}" for i in range(len(keep))]
    own = keyed(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), *(F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True))))
    n = batches_for(own)
    batched = dealt(own, n)
    # Shingles are counted by the leading bits of their hash, enough for the corpus: equal shingles have equal counts, so the
    # order is the same everywhere, and that is all that exactness needs.
    bits = min(64, 34 + max(0, int(n).bit_length()))
    low = U((1 << (64 - bits)) - 1)

    def batch_sets(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        parts, sizes = [], []
        for _, _, h, first in word_hashes(t["text"]):
            out, at = shingles(h, first, WORDS)
            parts.append(out)
            sizes.append(np.diff(at))
        return np.concatenate([*parts, np.zeros(0, U)]), np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))])

    def ask(t: pa.Table):
        return [summed(batch_sets(t)[0] & ~low)]

    def answer(batches):
        keys, total = summed(np.concatenate([b[0][0] for b in batches]), np.concatenate([b[0][1] for b in batches]))
        rank = np.where(total > 1, 1 + np.floor(4 * np.log2(np.maximum(total.astype(float), 1))), 0).astype(U)
        return [[rank[np.searchsorted(keys, b[0][0])]] for b in batches], [0]

    def use(t: pa.Table, replies: list[np.ndarray], _totals: list[int]) -> pa.Table:
        tokens, at = batch_sets(t)
        asked, where = np.unique(tokens & ~low, return_inverse=True)
        rank = replies[0][where]
        node, size, token, place, texts = [], np.diff(at), [], [], []
        text_of = t["text"]
        for r in range(t.num_rows):
            x, k = tokens[at[r]:at[r + 1]], rank[at[r]:at[r + 1]]
            node.append(set_hash(x) if len(x) else None)
            first = np.lexsort((x, k))[:opening(len(x))] if len(x) and k.max() else np.zeros(0, np.int64)
            held = np.flatnonzero(k[first] > 0)
            token.append(x[first[held]].view(np.int64))
            place.append(held)
            texts.append(text_of[r].as_py() if len(held) else None)
        return pa.table({"doc_id": t["doc_id"], **{n: t[n] for n in names}, "key": t["key"], "node": pa.array(node, pa.int64()), "n": pa.array(size, pa.int64()),
                         "token": pa.array(token, pa.list_(pa.int64())), "place": pa.array(place, pa.list_(pa.int64())), "text": pa.array(texts, pa.string())})

    kind = own.schema["doc_id"].dataType.simpleString()
    return persisted(counted(batched, n, ask, answer, use, ", ".join([f"doc_id {kind}", *ddl(own, names)]) + ", key bigint, node bigint, n bigint, token array<bigint>, "
                             "place array<bigint>, text string"), "sets")


def meeting(sets: DataFrame) -> DataFrame:
    """(a, b): stars over the nodes that meet in some block of an index list."""
    entries = (sets.filter(F.size("token") > 0).select("node", "n", F.explode(F.arrays_zip("token", "place")).alias("e"))
               .select("node", "n", "e.token", "e.place").withColumn("class", size_class(F.col("n"))))
    # After place p a set has n - p shingles left, so a linked set has at most that many * 100 / 80: blocks above are skipped.
    reach = size_class((F.col("n") - F.col("place")) * F.lit(100) / F.lit(PER_CENT))
    blocks = F.when(reach > F.col("class"), F.array("class", F.col("class") + 1)).otherwise(F.array("class"))
    listed = entries.select("node", "token", F.explode(blocks).alias("block")).groupBy("token", "block", "node").agg(F.lit(1).alias("one")).drop("one")
    leaders = listed.groupBy("token", "block").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("many")).filter("many > 1").drop("many")
    return listed.join(leaders, ["token", "block"]).filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, cluster, shared and both sizes of each node and its cluster's leader."""
    for b in slices(batches, 256):
        left, right = list(sets_of(b.column("text"))), list(sets_of(b.column("leader_text")))
        shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("node"), b.column("cluster"), pa.array(shared, pa.int64()),
                                          pa.array([len(x) for x in left], pa.int64()), pa.array([len(x) for x in right], pa.int64())],
                                         ["node", "cluster", "shared", "n", "leader_n"])
    release()


def derived_links(asking: list[np.ndarray], given: list[np.ndarray], leader: np.ndarray) -> np.ndarray:
    """Does each asking set link with each given one? Intersections with the leader are taken once; those with a given set follow from
    them and the shingles in which it differs from the leader."""
    base = np.array([len(np.intersect1d(x, leader, assume_unique=True)) for x in asking], np.float32)
    plus = [np.setdiff1d(y, leader, assume_unique=True) for y in given]
    minus = [np.setdiff1d(leader, y, assume_unique=True) for y in given]
    asked = np.unique(np.concatenate([*asking, np.zeros(0, U)]))
    between = np.intersect1d(np.unique(np.concatenate([*plus, *minus, np.zeros(0, U)])), asked, assume_unique=True)
    shared = np.repeat(base[:, None], len(given), 1)
    for c in range(0, len(between), 4096):  # bounded matrices
        cols = between[c:c + 4096]
        left, right = np.zeros((len(asking), len(cols)), np.float32), np.zeros((len(given), len(cols)), np.float32)
        for m, sets, value in ((left, asking, 1), (right, plus, 1), (right, minus, -1)):
            for r, x in enumerate(sets):
                x = x[(x >= cols[0]) & (x <= cols[-1])]
                if len(x):
                    at = np.minimum(np.searchsorted(cols, x), len(cols) - 1)
                    m[r, at[cols[at] == x]] = value
        shared += left @ right.T
    na, nb = (np.array([len(x) for x in s], np.float64) for s in (asking, given))
    return 100 * shared >= PER_CENT * (na[:, None] + nb[None, :] - shared)


def _block(t: pa.Table) -> pa.Table:
    """Links of the asking nodes of a block with the given ones, as a forest."""
    from sparkfolio.llm.graph import forest

    role, nodes = np.asarray(t["role"]), np.asarray(t["node"])
    sets = list(sets_of(t["text"]))
    a, g = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    leader = sets[int(np.flatnonzero(role == 2)[0])]
    linked = derived_links([sets[i] for i in a], [sets[i] for i in g], leader) & (nodes[a][:, None] != nodes[g][None, :])
    x, y = np.nonzero(linked)
    x, y = forest(nodes[a][x], nodes[g][y])
    return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", keep: Sequence[str] = (), group: str | None = None) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links, the row's own where there is none), ``keep``, and as
    ``group`` a number of the row's component, which rows without an id have too (null without words).

    Texts of 1 to 4 words are one shingle; null and wordless texts have none and link with nothing. Equal sets always link.
    Repeated rows are rows of the same component. No link is dropped; pairs are never listed within a group.
    """
    sets = document_sets(docs, id_col, text, keep)
    some = sets.filter("node is not null")
    nodes = some.groupBy("node").agg(F.min("doc_id").alias("least"))
    clusters = persisted(components(meeting(sets)).withColumnRenamed("component", "cluster"), "clusters")
    # One text for each node of a cluster.
    texts = some.filter("text is not null").select("node", "key", "text")
    one = texts.groupBy("node").agg(F.min("key").alias("key"))
    held = persisted(clusters.join(one, "node").join(texts.drop("node"), "key").dropDuplicates(["node"]).select("node", "cluster", "text"), "texts")
    leader = held.filter("node = cluster").select("cluster", F.col("text").alias("leader_text"))
    first = persisted(held.filter("node <> cluster").join(leader, "cluster").select("node", "cluster", "text", "leader_text")
                      .mapInArrow(_compared, "node bigint, cluster bigint, shared bigint, n bigint, leader_n bigint"), "first")
    union = F.col("n") + F.col("leader_n") - F.col("shared")
    first = first.withColumn("far", 1 - F.col("shared") / union).withColumn("linked", 100 * F.col("shared") >= PER_CENT * union)
    # Who is not linked with the leader asks all nodes that the distances to the leader leave.
    open_ = (first.groupBy("cluster").agg(F.min(F.when(~F.col("linked"), F.col("far"))).alias("nearest"),
                                          F.sum((~F.col("linked")).cast("int")).alias("asking"), F.count(F.lit(1)).alias("size"))
             .filter("asking > 0 and size > 1"))
    open_ = persisted(open_, "open")  # a table, not an aggregate: Spark can then split a large cluster in the join
    left = (first.join(open_, "cluster").filter(~F.col("linked") | (F.col("far") >= F.col("nearest") - (1 - PER_CENT / 100) - 1e-9))
            .select("node", "cluster", "linked", F.ceil(F.col("asking") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("size") / BLOCK).cast("int").alias("columns")))
    left = left.join(held.select("node", "text"), "node")
    row, column = F.pmod(F.xxhash64("node", F.lit(1)), F.col("rows")).cast("int"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("columns")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asks = left.filter("not linked").select("cluster", row.alias("i"), every("columns").alias("j"), F.lit(0).alias("role"), "node", "text")
    gives = left.select("cluster", every("rows").alias("i"), column.alias("j"), F.lit(1).alias("role"), "node", "text")
    leads = (open_.select("cluster", F.ceil(F.col("asking") / BLOCK).cast("int").alias("rows"), F.ceil(F.col("size") / BLOCK).cast("int").alias("columns"))
             .join(leader, "cluster").select("cluster", every("rows").alias("i"), "columns", "leader_text")
             .select("cluster", "i", every("columns").alias("j"), F.lit(2).alias("role"), F.col("cluster").alias("node"), F.col("leader_text").alias("text")))
    further = asks.unionByName(gives).unionByName(leads).groupBy("cluster", "i", "j").applyInArrow(lambda t: released(_block(t)), "a bigint, b bigint")
    links = first.filter("linked").select(F.col("node").alias("a"), F.col("cluster").alias("b")).unionByName(further)
    joined = nodes.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = persisted(joined.groupBy("component").agg(F.min("least").alias("component_id")), "names")  # large components are split in the join
    named = joined.join(names, "component").select("node", "component_id", "component")
    return (sets.select("doc_id", "node", "n", *(f"_k{i}" for i in range(len(keep)))).join(named, "node", "left")
            .select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"),
                    *(F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)), *([F.col("component").alias(group)] if group else [])))

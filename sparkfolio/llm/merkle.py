"""Merkle manifest of a table by sibling-shift self-joins.

Rows become leaves, the leaves of a group stand in order, and every few consecutive nodes become their parent until one is left. All
nodes of a level are one table (tree, at, digest). A node's siblings are found by equijoins of the level with itself on the place that
the node computes for them (XOR with 1 in pairs, else the further slots of its run, one join a slot). Slot 0 then emits the parent. The
tops of the groups are the leaves of one more tree. Paths go down again, one join of a node with its parent for each level.

Places come from a range partition by (group, order): rows are numbered within each range, and ranges are shifted by the rows before
them, so a group with a third of all rows is in many tasks. Each level is written once to the shared folder, with a third of the rows
of the level below. To the driver go one size, one digest and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.session import persisted

PATH = "array<struct<left:string,right:string>>"


def field(c: Column) -> Column:
    """``-`` for null, else the UTF-8 bytes of the value written as text, a colon, and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), "-").otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf_digest(*cols: Column) -> Column:
    return F.sha2(F.concat(*map(field, cols)), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The top that a leaf and the siblings on its path give."""
    return F.aggregate(path, leaf, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def proof_digest(path: Column) -> Column:
    """Digest of all siblings on the path, from the leaf up, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def numbered(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` with at (from 0, in ``order``, nulls first) and size within each ``key`` (null is a key); ties of all columns in
    ``order`` may stand either way. ``rows`` is read twice, so it should be a table."""
    ranged = rows.withColumn("_tie", F.monotonically_increasing_id())
    ranged = persisted(ranged.repartitionByRange(*key, *order, "_tie").withColumn("_range", F.spark_partition_id()), "ranges")
    some = ranged.groupBy("_range", *key).agg(F.count(F.lit(1)).alias("_n"))
    all_of = Window.partitionBy(*key)
    before = some.withColumn("_before", F.coalesce(F.sum("_n").over(all_of.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = before.withColumn("size", F.sum("_n").over(all_of)).drop("_n")
    before = before.select(F.col("_range").alias("_r"), *(F.col(k).alias(f"_b_{k}") for k in key), "_before", "size")
    inside = F.row_number().over(Window.partitionBy("_range", *key).orderBy(*order, "_tie")) - 1
    same = F.col("_range") == F.col("_r")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_b_{k}"))
    placed = ranged.withColumn("_in", inside).join(before, same)
    return placed.select(*rows.columns, (F.col("_before") + F.col("_in")).cast("long").alias("at"), F.col("size").cast("long").alias("size"))


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, at, digest, ...) with left and right: the digests of the others of its run before and after it, joined."""
    slot = F.pmod("at", F.lit(arity))
    out = nodes
    for d in range(1, arity):
        other = nodes.select(F.col("tree").alias("_t"), F.col("at").alias("_a"), F.col("digest").alias(f"_d{d}"))
        sibling = F.col("at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("at") - slot + F.pmod(slot + d, F.lit(arity))
        out = out.join(other, (F.col("tree") == F.col("_t")) & (sibling == F.col("_a")), "left").drop("_t", "_a")
    digests = F.array(*(F.col(f"_d{d}") for d in range(1, arity)))

    def side(wanted) -> Column:
        return F.concat(*(F.when(wanted(slot, F.lit(s)), F.coalesce(F.get(digests, F.pmod(F.lit(s) - slot, F.lit(arity)).cast("int") - 1), F.lit("")))
                          .otherwise("") for s in range(arity)))

    return (out.withColumns({"left": side(lambda own, s: s < own), "right": side(lambda own, s: s > own)})
            .drop(*(f"_d{d}" for d in range(1, arity))))


def raised(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """The levels of all trees, leaves first, each with the nodes that have a run to be in and their siblings; and the tops
    (tree, depth, digest). ``nodes`` (tree, at, size, digest, ...) is a table."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    levels, tops, now = [], [], nodes
    while True:
        tops.append(now.filter("size = 1").select("tree", F.lit(len(levels)).alias("depth"), "digest"))
        if most <= 1:
            break
        level = persisted(with_siblings(now.filter("size > 1"), arity), f"level{len(levels)}")
        levels.append(level)
        now = level.filter(F.pmod("at", F.lit(arity)) == 0).select(
            "tree", F.expr(f"at div {arity}").alias("at"), F.expr(f"(size + {arity - 1}) div {arity}").alias("size"),
            F.sha2(F.concat("digest", "right"), 256).alias("digest"))
        most = -(-most // arity)
    every = tops[0]
    for t in tops[1:]:
        every = every.unionByName(t)
    return levels, every


def lowered(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, arity: int, extra: Sequence[str]) -> DataFrame:
    """(tree, at, extra, top, path) of the leaves; path has the siblings from the leaf to the top and on with the top's own ``path``.
    ``tops`` (tree, depth, top, path) is a table."""
    def begin(depth: int) -> DataFrame:
        return tops.filter(F.col("depth") == depth).select("tree", F.lit(0).cast("long").alias("at"), "top", "path")

    now = begin(len(levels))
    for depth in range(len(levels) - 1, -1, -1):
        above = now.select(F.col("tree").alias("_t"), F.col("at").alias("_a"), "top", F.col("path").alias("_path"))
        level = levels[depth].withColumn("_up", F.expr(f"at div {arity}"))
        joined = level.join(above, (F.col("tree") == F.col("_t")) & (F.col("_up") == F.col("_a")))
        held = list(extra) if depth == 0 else []
        joined = joined.select("tree", "at", *held, "top", F.concat(F.array(F.struct("left", "right")), "_path").alias("path"))
        if depth:
            now = joined.unionByName(begin(depth))
        else:
            lone = nodes.filter("size = 1").select("tree", *extra).join(begin(0), "tree")
            now = joined.unionByName(lone.select("tree", "at", *extra, "top", "path"))
    return now if levels else nodes.select("tree", *extra).join(begin(0), "tree").select("tree", "at", *extra, "top", "path")


def manifest(leaves: DataFrame, group: str, order: Sequence[str], digest: str, arity: int = 3, keep: Sequence[str] = ()) -> DataFrame:
    """``keep``, leaf, subroot, root and path (from the leaf over its subroot to the root) of every row of ``leaves``.

    Leaves of a group stand by ``order``, then digest, nulls first; null is a group; groups stand in their order, null first. Every
    ``arity`` (2 or more) consecutive nodes, also a shorter last run, become the digest of their digests, until one is left; a
    lone leaf is its subroot, a lone subroot the root. Rows alike in all of these columns take neighbouring places. Without rows the result is
    empty. Columns may have any names.
    """
    if arity < 2:
        raise ValueError("a run needs two nodes or more")
    names = [f"_k{i}" for i in range(len(keep))]
    orders = [f"_o{i}" for i in range(len(order))]
    own = leaves.select(F.col(f"`{group}`").alias("group"), *(F.col(f"`{o}`").alias(n) for o, n in zip(order, orders, strict=True)),
                        F.col(f"`{digest}`").alias("digest"), *(F.col(f"`{k}`").alias(n) for k, n in zip(keep, names, strict=True)))
    own = persisted(own, "leaves")
    placed = persisted(numbered(own, ["group"], [*orders, "digest", *names]).drop(*orders), "placed")
    groups = numbered(persisted(placed.select("group").distinct(), "groups"), [], ["group"])
    groups = groups.select(F.col("group").alias("_g"), F.col("at").alias("tree"))
    nodes = persisted(placed.join(groups, F.col("group").eqNullSafe(F.col("_g"))).select("tree", "at", "size", "digest", *names), "nodes")
    levels, tops = raised(nodes, arity)
    tops = persisted(tops, "tops")
    many = tops.count()
    upper = tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(many).cast("long").alias("size"), "digest", "depth")
    roots, root = raised(upper, arity)
    top = root.first()
    root = root.select("tree", "depth", F.col("digest").alias("top"), F.array().cast(PATH).alias("path"))
    joined = lowered(upper, roots, root, arity, ["depth", "digest"])
    starts = persisted(joined.select(F.col("at").alias("tree"), "depth", F.col("digest").alias("top"), "path"), "starts")
    done = lowered(nodes, levels, starts, arity, ["digest", *names])
    return done.select(*(F.col(n).alias(k) for n, k in zip(names, keep, strict=True)), F.col("digest").alias("leaf"), F.col("top").alias("subroot"),
                       F.lit(top["digest"] if top else None).cast("string").alias("root"), "path")


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def document_manifest(docs: DataFrame, tampered: Column, arity: int = 3) -> DataFrame:
    """Manifest of documents by source and id, and whether each verifies: doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified. ``tampered`` (true, false or null: not) marks the documents whose texts lose their line ends before they are verified.
    Nulls in any column are a value of their own (``-``); extra columns are no part of a leaf."""
    own = docs.select(*FIELDS, tampered.alias("_tampered"))
    cut = F.when(F.col("_tampered") & F.contains("text", F.lit("\n")), leaf_digest(*(F.col(f) for f in FIELDS[:-1]), F.replace("text", F.lit("\n"), F.lit(""))))
    own = own.select("doc_id", "source", leaf_digest(*map(F.col, FIELDS)).alias("leaf"), cut.alias("tampered"))
    tree = manifest(own, "source", ["doc_id"], "leaf", arity, keep=("doc_id", "tampered"))
    tree = tree.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"),
                       folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return tree.withColumn("verified", F.col("folded_root") == F.col("root"))

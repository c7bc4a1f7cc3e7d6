"""Exact near-duplicate vectors by a metric range join.

Cosine is compared as the distance of unit vectors, a metric. Within each label a few vectors are pivots; each vector belongs to the
cell of its nearest pivot, and meets another cell only where the triangle inequality cannot rule out a neighbour there. Cells are cut
into blocks; two blocks meet in one task, to which either sends only what may have a neighbour in the other's cell. What meets is
compared by the cosine in double precision. Where nothing can be ruled out, as with random vectors, all pairs are compared: a vector
is then copied once for each block of its label.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.graph import components, forest
from sparkfolio.session import persisted

# These divide the work; no result depends on them.
CELL = 16_384  # vectors of a label for each pivot
MAX_PIVOTS = 64  # of a label; bounds what is broadcast
BLOCK = 16_384  # vectors of a block, fewer where they are long
BLOCK_VALUES = 1 << 22  # components of a block: 32 MB in double precision
TILE = 512, 4_096  # rows and columns of cosines held at once
MANY = 1 << 32  # block numbers: cell * MANY + part


def usable(vec: str, label: str):
    """Not null, not zero, no null or non-finite components, and a label."""
    v = F.col(vec)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col(label).isNotNull() & v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def near_vectors(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vec: str = "embedding", label: str = "label",
                 cell: int = CELL) -> DataFrame:
    """One row for each input row: id, n_links, component_id (smallest linked id), kept.

    Rows with a null, zero or broken vector or without a label link with nothing; vectors of different length are never
    compared. Equal vectors of a label are joined once and then counted. Ids are longs; a null id links like any other
    but does not name a component.
    """
    whole = vectors.schema[vec].dataType.elementType.typeName() != "float"  # floats stay as short as they are until they are compared
    v = F.transform(vec, lambda x: x.cast("double")) if whole else F.col(vec)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label).alias("label"), v.alias("v"))
    good = rows.filter(usable("v", "label"))
    # Equal vectors become one point; its number is made of its content.
    points = (good.groupBy("label", "v").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
              .select(F.xxhash64("label", F.size("v")).alias("group"), F.xxhash64("label", "v").alias("point"), "copies", "least", "v"))
    points = persisted(points, "points")
    sizes = points.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    pivots = (points.join(sizes, "group").withColumn("pivots", F.least(F.ceil(F.col("n") / cell), F.lit(MAX_PIVOTS)))
              .filter(F.col("pivots") > 1)
              # a sample by hash, then exactly the asked number
              .filter(F.pmod(F.xxhash64("point", F.lit(1)), F.col("n")) < 4 * F.col("pivots") + 16)
              .groupBy("group", "pivots").agg(F.sort_array(F.collect_list(F.struct(F.xxhash64("point", F.lit(2)).alias("o"), "v"))).alias("p"))
              .select("group", F.expr("transform(slice(p, 1, int(pivots)), x -> x.v)").alias("pivots")))
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9  # distance of unit vectors at the threshold
    kind = "double" if whole else "float"
    placed = (points.select("group", "point", "copies", "v").join(F.broadcast(pivots), "group", "left")  # at most MAX_PIVOTS vectors for each label
              .mapInArrow(lambda it: _placed(it, reach), f"group long, point long, copies long, v array<{kind}>, home long, near array<bigint>"))
    placed = persisted(placed, "placed")
    # The blocks of each cell, for labels of more than one block: no more rows than blocks.
    most = F.least(F.lit(BLOCK), F.greatest(F.lit(1), F.floor(F.lit(BLOCK_VALUES) / F.first(F.size("v")))))
    parts = placed.groupBy("group", "home").agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    cut = parts.groupBy("group").agg(F.map_from_entries(F.collect_list(F.struct("home", "parts"))).alias("cut"), F.sum("parts").alias("n")).filter("n > 1")
    tagged = placed.join(F.broadcast(cut.select("group", "cut")), "group", "left")
    cells = F.when(F.col("cut").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.flatten(F.transform(
        F.filter("near", lambda c: F.map_contains_key("cut", c)),
        lambda c: F.transform(F.sequence(F.lit(0).cast("long"), F.try_element_at("cut", c) - 1), lambda i: c * MANY + i))))
    own = F.when(F.col("cut").isNull(), F.lit(0).cast("long")).otherwise(
        F.col("home") * MANY + F.pmod(F.xxhash64("point", F.lit(3)), F.try_element_at("cut", F.col("home"))))
    sent = tagged.select("group", "point", "copies", "v", own.alias("own"), F.explode(cells).alias("other"))
    sent = sent.select("group", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "point", "copies", "v")
    met = sent.groupBy("group", "low", "high").applyInArrow(lambda t: _met(t, threshold), "point long, links long, root long")
    met = persisted(met, "met")  # read for the counts and for the components; compared once
    counted = met.groupBy("point").agg(F.sum("links").alias("links"))
    roots = components(met.filter("root is not null").select(F.col("point").alias("a"), F.col("root").alias("b")))
    classes = (points.select("point", "copies", "least").join(counted, "point", "left").join(roots, F.col("point") == F.col("node"), "left")
               .withColumn("component", F.coalesce("component", "point")))
    names = persisted(classes.groupBy("component").agg(F.min("least").alias("component_id")), "names")
    named = classes.join(names, "component").select("point", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    keyed = rows.withColumn("point", F.when(usable("v", "label"), F.xxhash64("label", "v")))
    return (keyed.join(named, "point", "left")
            .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component_id", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True))))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)  # no overflow of squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """Vectors of one length as rows in double precision."""
    return np.asarray(lists.flatten(), dtype=np.float64).reshape(len(lists), -1)


def _placed(batches, reach: float):
    """The own cell of each point, and the cells in which a point within ``reach`` could be, the own one included."""
    for b in batches:
        t = pa.Table.from_batches([b])
        groups = t.column("group").to_numpy()
        for group in np.unique(groups):
            g = t.filter(pa.array(groups == group)).combine_chunks()
            given = g.column("pivots")[0]
            if not given.is_valid:
                home, near = np.zeros(len(g), np.int64), np.ones((len(g), 1), bool)
            else:
                u, p = _unit(_matrix(g.column("v").chunk(0))), _unit(np.array(given.as_py(), dtype=np.float64))
                square = np.maximum(0, 2 - 2 * u @ p.T)
                home = square.argmin(1)
                d = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]  # from the own pivot to the others
                gap = square - square[np.arange(len(u)), home][:, None]
                # Distance to the plane between two pivots: a neighbour beyond it is at least that far away.
                near = gap <= 2 * d * reach + 1e-9
                near[np.arange(len(u)), home] = True
            ends = np.concatenate([[0], near.sum(1).cumsum()]).astype(np.int32)
            cells = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.nonzero(near)[1].astype(np.int64)))
            yield from (g.select(["group", "point", "copies", "v"]).append_column("home", pa.array(home.astype(np.int64)))
                        .append_column("near", cells).to_batches())


def _met(t: pa.Table, threshold: float) -> pa.Table:
    """Links between two blocks, or within one: how many each linked point has, and the smallest point linked. A tile of cosines is held at once."""
    own, points, copies = (t.column(c).to_numpy() for c in ("own", "point", "copies"))
    low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
    raw = _matrix(t.column("v").combine_chunks())
    unit = _unit(raw)
    a, b = np.nonzero(own == low)[0], np.nonzero(own == high)[0]
    links, node, root = np.zeros(len(points), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for r in range(0, len(a), TILE[0]):
        x = a[r:r + TILE[0]]
        for c in range(0, len(b), TILE[1]):
            y = b[c:c + TILE[1]]
            cos = unit[x] @ unit[y].T
            for i, j in zip(*np.nonzero(np.abs(cos - threshold) < 1e-9), strict=True):  # too close for the product: by definition, in double precision
                p, q = raw[x[i]], raw[y[j]]
                cos[i, j] = math.fsum(p * q) / (math.sqrt(math.fsum(p * p)) * math.sqrt(math.fsum(q * q)))
            linked = (cos >= threshold) & (points[x][:, None] != points[y][None, :])
            links[x] += linked @ copies[y]
            if low != high:
                links[y] += copies[x] @ linked
            # Every link goes into a forest: as many rows as points, no link between components lost.
            i, j = np.nonzero(linked)
            node, root = forest(np.concatenate([node, points[x][i]]), np.concatenate([root, points[y][j]]))
    some = links > 0
    return pa.table({"point": np.concatenate([points[some], node]), "links": np.concatenate([links[some], np.zeros(len(node), np.int64)]),
                     "root": pa.array(np.concatenate([np.zeros(some.sum(), np.int64), root]), mask=np.arange(some.sum() + len(node)) < some.sum())})

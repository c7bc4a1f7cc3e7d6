"""Line and word tables: sections, columns, reading order.

The layout alone comes from partial aggregates over distinct coordinates, which a page bounds. Lines are assembled in one row
for each document, so that words are moved once; a document's words are taken to fit a row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.functions import contact
from sparkfolio.functions import text as tx
from sparkfolio.functions.arrays import cut_at, int_range, let, ranked_terms, sealed, terms


def carry_sections(lines: DataFrame, key: str, line_no: str, mark: Column) -> DataFrame:
    """Lines with the section of the last header above them; header lines removed.

    ``mark`` is the section name on header lines, null elsewhere.  Headers are few, so each
    document's header positions meet its lines in a join: a document with very many lines can be
    split by skew handling, which a window over the document could not.
    """
    marked = lines.withColumn("_m", mark)
    heads = marked.filter("_m is not null").groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col(line_no).alias("n"), F.col("_m").alias("s")))).alias("_h"))
    body = marked.filter("_m is null").drop("_m").join(heads, key, "left")
    last = F.array_max(F.filter("_h", lambda h: h["n"] < F.col(line_no)))
    return body.withColumn("section", F.coalesce(last["s"], F.lit("header"))).drop("_h")


def gutters(words: DataFrame, min_gap: float = 25.0) -> DataFrame:
    """(doc_id, width, body_top, gutter, layout): column layout of each document.

    The gutter is the middle of the widest empty band between word starts in the central 70 % of
    the page below its top fifth; both sides must hold a tenth of the words.
    """
    size = words.groupBy("doc_id").agg(F.max(F.coalesce("x1", "x0")).alias("width"),
                                       (F.max(F.coalesce("bottom", F.col("top") + 12)) * 0.20).alias("body_top"))
    starts = words.join(size, "doc_id").filter(F.col("top") > F.col("body_top")).groupBy(
        "doc_id", "width", "body_top", F.round("x0", 1).alias("x")).agg(F.count("*").alias("n"))
    central = starts.filter((F.col("x") >= F.col("width") * 0.15) & (F.col("x") <= F.col("width") * 0.85))
    nxt = F.lead("x").over(Window.partitionBy("doc_id").orderBy("x"))
    widest = central.withColumn("nx", nxt).filter("nx is not null").groupBy("doc_id").agg(
        F.max_by(F.struct("x", "nx"), F.struct(F.round(F.col("nx") - F.col("x"), 6), -F.col("x"))).alias("g"))
    wide = widest.filter(F.round(F.col("g.nx") - F.col("g.x"), 6) >= min_gap).select(
        "doc_id", ((F.col("g.x") + F.col("g.nx")) / 2).alias("gutter"))
    sides = starts.join(wide, "doc_id").groupBy("doc_id", "gutter").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("x") < F.col("gutter"), F.col("n")).otherwise(0)).alias("left"))
    both = (F.col("total") >= 5) & (F.col("left") >= F.col("total") * 0.10) & (F.col("total") - F.col("left") >= F.col("total") * 0.10)
    good = sides.filter(both).select("doc_id", "gutter")
    return size.join(good, "doc_id", "left").withColumn(
        "layout", F.when(F.col("gutter").isNotNull(), "two_columns").otherwise("single_column"))


def line_anchors(words: DataFrame, tolerance: float = 3.0) -> DataFrame:
    """(doc_id, page, top, anchor): each distinct height with the height its line starts at.

    A word joins a line while within ``tolerance`` of the line's first word, so the heights of a
    page are folded in order; only distinct heights are gathered.
    """
    tops = words.groupBy("doc_id", "page", "top").agg(F.lit(1).alias("_")).groupBy("doc_id", "page").agg(
        F.sort_array(F.collect_list("top")).alias("tops"))
    start = F.struct(F.lit(None).cast("double").alias("a"), F.array().cast("array<double>").alias("out"))

    def step(s, t):
        a = F.when(s["a"].isNull() | (t - s["a"] > tolerance), t).otherwise(s["a"])
        return F.struct(a.alias("a"), F.concat(s["out"], F.array(a)).alias("out"))

    folded = F.aggregate("tops", start, step)["out"]
    return tops.select("doc_id", "page", F.explode(F.arrays_zip("tops", folded.alias("anchors"))).alias("z")).select(
        "doc_id", "page", F.col("z.tops").alias("top"), F.col("z.anchors").alias("anchor"))


def with_layout(words: DataFrame) -> DataFrame:
    """(doc_id, ws, gutter, body_top, layout): the words of each document in one row, by page, height and place, with the layout that ``gutters`` tells.

    Words are moved once; what is known of a document then stands in its row and meets its words there. Words without a document are left out.
    """
    bold = F.contains(F.lower(F.coalesce("fontname", F.lit(""))), F.lit("bold"))
    word = F.struct("page", "top", "x0", "text", "size", bold.alias("bold"))
    placed = words.filter("doc_id is not null").select("doc_id", word.alias("w"), F.coalesce("x1", "x0").alias("right"), F.coalesce("bottom", F.col("top") + 12).alias("bottom"))
    docs = placed.repartition("doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list("w")).alias("ws"), F.max("right").alias("width"), (F.max("bottom") * 0.20).alias("body_top"))
    starts = F.transform(F.filter("ws", lambda w: w["top"] > F.col("body_top")), lambda w: F.round(w["x0"], 1))
    docs = sealed(docs.select("doc_id", "ws", "body_top", let(starts, lambda xs: gutter_of(xs, F.col("width"))).alias("gutter")))
    return docs.withColumn("layout", F.when(F.col("gutter").isNotNull(), "two_columns").otherwise("single_column"))


def gutter_of(xs: Column, width: Column, min_gap: float = 25.0) -> Column:
    """The gutter that ``gutters`` finds for word starts ``xs`` below the page head; null for a single column."""
    def wide(c):
        gaps = F.transform(int_range(F.lit(1), F.size(c) - 1), lambda i: F.struct(
            F.round(F.get(c, i) - F.get(c, i - 1), 6).alias("gap"), (-F.get(c, i - 1)).alias("first"), ((F.get(c, i - 1) + F.get(c, i)) / 2).alias("middle")))
        return let(F.array_max(gaps), lambda g: F.when(g["gap"] >= min_gap, g["middle"]))

    def both(g):
        left = F.size(F.filter(xs, lambda x: x < g))
        return F.when((F.size(xs) >= 5) & (left >= F.size(xs) * 0.10) & (F.size(xs) - left >= F.size(xs) * 0.10), g)

    central = F.array_sort(F.array_distinct(F.filter(xs, lambda x: (x >= width * 0.15) & (x <= width * 0.85))))
    return let(let(central, wide), both)


def lines_of_page(ws: Column, tolerance: float = 3.0) -> Column:
    """array<array<word>>: the sorted words of a page cut into lines, as ``line_anchors`` tells them apart."""
    begin = F.struct(F.lit(None).cast("double").alias("a"), F.lit(1).alias("i"), F.array().cast("array<int>").alias("at"))

    def step(s, w):
        t = w["top"]
        new = s["a"].isNull() | ((t - s["a"] > tolerance) & (t != s["a"]))
        return F.when(new, F.struct(t.alias("a"), (s["i"] + 1).alias("i"), F.concat(s["at"], F.array(s["i"])).alias("at"))).otherwise(
            F.struct(s["a"].alias("a"), (s["i"] + 1).alias("i"), s["at"].alias("at")))

    return let(F.aggregate(ws, begin, step)["at"], lambda at: cut_at(ws, at))


def cut_lines(ws: Column, gutter: Column, body_top: Column) -> Column:
    """array<struct<page, anchor, col, ws>>: the lines of a document's sorted words; those below the page head are cut at the gutter into left and
    right. Words without page or height are in no line."""
    def pages(w):
        return let(F.filter(int_range(F.lit(1), F.size(w)), lambda i: (i == 1) | (F.get(w, i - 1)["page"] != F.get(w, i - 2)["page"])), lambda at: cut_at(w, at))

    def sides(x):
        first = F.get(x, F.lit(0))
        part = lambda col, ws: F.struct(first["page"].alias("page"), first["top"].alias("anchor"), F.lit(col).alias("col"), ws.alias("ws"))
        in_left = lambda w: F.coalesce(w["x0"] < gutter, F.lit(False))
        cut = F.array(part("left", F.filter(x, in_left)), part("right", F.filter(x, lambda w: ~in_left(w))))
        return F.when(gutter.isNull() | (first["top"] < body_top), F.array(part("full", x))).otherwise(F.filter(cut, lambda p: F.size(p["ws"]) > 0))

    lines = let(F.filter(ws, lambda w: w["page"].isNotNull() & w["top"].isNotNull()), lambda w: F.flatten(F.transform(pages(w), lambda p: lines_of_page(p))))
    return F.flatten(F.transform(lines, sides))


def line_fields(ws: Column) -> dict[str, Column]:
    """text, size, bold, x0, top of a line from its words, joined left to right."""
    parts = F.sort_array(F.transform(ws, lambda w: F.struct(w["x0"], w["top"], w["text"].alias("text"))))
    return {"text": F.trim(F.array_join(parts["text"], " ")), "size": F.coalesce(F.array_max(ws["size"]), F.lit(10.0)),
            "bold": F.exists(ws, lambda w: w["bold"]), "x0": F.array_min(ws["x0"]), "top": F.array_min(ws["top"])}


def assemble_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, anchor, col, text, size, bold, x0, top): words of a line joined left to right.

    Lines below the page head are cut at the document's gutter into left and right.
    """
    lines = with_layout(words).select("doc_id", F.inline(cut_lines(F.col("ws"), F.col("gutter"), F.col("body_top"))))
    return lines.select("doc_id", "page", "anchor", "col", *(c.alias(n) for n, c in line_fields(F.col("ws")).items()))


def reading_key(body_top: Column | None = None) -> Column:
    """Sort key of a line: page, then head, left and right zones, then height."""
    zone = F.when(F.col("col") == "full", 0).when(F.col("col") == "left", 1).otherwise(2)
    return F.struct(F.col("page"), zone.alias("zone"), F.col("anchor"))


def reading_order(lines: DataFrame) -> DataFrame:
    """(doc_id, page, anchor, col, pos): lines numbered in reading order from 1. Only the places of lines are gathered, no text is moved."""
    order = F.sort_array(F.collect_list(F.struct(reading_key().alias("key"), F.col("col"))))
    placed = lines.groupBy("doc_id").agg(order.alias("ls")).select("doc_id", F.posexplode("ls").alias("i", "l"))
    return placed.select("doc_id", F.col("l.key.page").alias("page"), F.col("l.key.anchor").alias("anchor"), F.col("l.col").alias("col"), (F.col("i") + 1).alias("pos"))


def body_sizes(lines: DataFrame, order: Column) -> DataFrame:
    """(doc_id, body_size): most frequent line size rounded to 0.1, first seen on ties, 10 if none."""
    counted = lines.filter((F.trim("text") != "") & (F.col("size") > 0)).groupBy(
        "doc_id", F.round("size", 1).alias("s")).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counted.groupBy("doc_id").agg(F.min_by("s", F.struct(-F.col("n"), "first")).alias("body_size"))
    return lines.select("doc_id").distinct().join(best, "doc_id", "left").withColumn(
        "body_size", F.coalesce("body_size", F.lit(10.0)))


def head_threshold(lines: DataFrame, share: float = 0.12) -> DataFrame:
    """(doc_id, head_top): the height below which a line counts as top of the document."""
    per = lines.groupBy("doc_id", "top").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id")
    cum = per.withColumn("c", F.sum("n").over(w.orderBy("top"))).withColumn("total", F.sum("n").over(w))
    return cum.filter(F.col("c") >= F.floor(F.col("total") * share) + 1).groupBy("doc_id").agg(F.min("top").alias("head_top"))


def top_lines(lines: DataFrame, share: float = 0.12) -> DataFrame:
    """(doc_id, page, col, anchor) of the lines at the top of their document (``head_threshold``). Only the places of lines are gathered."""
    placed = lines.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("top", "page", "col", "anchor"))).alias("ls"))
    return placed.select("doc_id", F.inline(at_top(F.col("ls"), share))).select("doc_id", "page", "col", "anchor")


def at_top(lines: Column, share: float = 0.12) -> Column:
    """Of one document's lines, sorted by ``top``, those up to the height that ``head_threshold`` tells."""
    head = F.array_min(F.slice(lines["top"], F.floor(F.size(lines) * share).cast("int") + 1, F.size(lines)))
    return let(head, lambda h: F.filter(lines, lambda x: x["top"] <= h))


def document_lines(words: DataFrame) -> DataFrame:
    """(doc_id, lines, top_lines, body_size, layout): each document's lines in reading order.

    A document is one record, so its assembled lines are gathered in one row for parsing;
    ``top_lines`` are the header candidates of two-column documents, by height.
    """
    def placed(x):
        f = {n: c.alias(n) for n, c in line_fields(x["ws"]).items()}
        zone = F.when(x["col"] == "full", 0).when(x["col"] == "left", 1).otherwise(2)
        return F.struct(F.struct(x["page"].alias("page"), zone.alias("zone"), x["anchor"].alias("anchor")).alias("key"),
                        F.struct(f["text"], f["size"], f["bold"], f["x0"], f["top"], x["col"].alias("col")).alias("line"))

    cut = F.transform(cut_lines(F.col("ws"), F.col("gutter"), F.col("body_top")), placed)
    docs = sealed(with_layout(words).select("doc_id", "layout", F.sort_array(cut).alias("ls"))).filter(F.size("ls") > 0)
    by_height = F.sort_array(F.transform("ls", lambda x: F.struct(x["line"]["top"].alias("top"), x["key"].alias("key"), x["line"].alias("line"))))
    return sealed(docs.select("doc_id", F.col("ls.line").alias("lines"), at_top(by_height)["line"].alias("top_lines"), body_size_of(F.col("ls.line")).alias("body_size"), "layout"))


def body_size_of(lines: Column) -> Column:
    """What ``body_sizes`` tells of one document's lines in reading order."""
    sizes = F.transform(F.filter(lines, lambda x: (F.trim(x["text"]) != "") & (x["size"] > 0)), lambda x: F.round(x["size"], 1))
    return F.coalesce(F.get(terms(ranked_terms(sizes, 1)), F.lit(0)), F.lit(10.0))


def band_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, width: float) -> DataFrame:
    """Pairs of rows with equal ``keys`` whose ``at`` differs by ``width`` at most: columns left and right (structs).

    A right row stands in the bin of its place, a left row asks its own bin and both neighbours, so rows meet by equality and a document with very
    many lines is split by its bins. Null places pair with nothing.
    """
    bin_ = F.floor(F.col(at) / width)
    a = left.filter(F.col(at).isNotNull()).select(*keys, F.struct(*left.columns).alias("left"), F.explode(F.sequence(bin_ - 1, bin_ + 1)).alias("_bin"))
    b = right.filter(F.col(at).isNotNull()).select(*keys, F.struct(*right.columns).alias("right"), bin_.alias("_bin"))
    met = a.join(b, [*keys, "_bin"])
    return met.filter(F.abs(F.col("left")[at] - F.col("right")[at]) <= width).select("left", "right")


def header_names(lines: DataFrame, order: Column, band: float = 15.0) -> DataFrame:
    """(doc_id, name) from a table of header lines (doc_id, text, size, top, col): the largest line without email or phone, joined with the
    first line of the other column at its height, as ``header_record`` does within one row. Documents without such a line have no row."""
    ranked = lines.withColumn("_order", order)
    named = ranked.filter((tx.strip(F.col("text")) != "") & ~contact.has_contact(F.col("text"), links=False))
    best = named.groupBy("doc_id").agg(F.min_by(F.struct("text", "top", "col"), F.struct(-F.col("size"), "_order")).alias("n")).select("doc_id", "n.*")
    split = best.filter(F.col("col").isin("left", "right"))
    others = ranked.filter((tx.strip(F.col("text")) != "") & ~contact.has_contact(F.col("text"))).select("doc_id", "text", "top", "col", "_order")
    pairs = band_pairs(split, others, ["doc_id"], "top", band).filter(F.col("right.col") == F.when(F.col("left.col") == "left", "right").otherwise("left"))
    first = pairs.groupBy(F.col("left.doc_id").alias("doc_id")).agg(F.min_by("right.text", "right._order").alias("other"))
    base, other = tx.strip(F.col("text")), tx.strip(F.col("other"))
    name = F.when(F.col("other").isNull(), base).when(F.col("col") == "left", F.concat_ws(" ", base, other)).otherwise(F.concat_ws(" ", other, base))
    return best.join(first, "doc_id", "left").select("doc_id", name.alias("name"))

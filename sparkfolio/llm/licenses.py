"""License scans by diagonal voting, in DataFrame functions only.

Every text gives a hash for each of its rolling word k-grams, which meet the positions of the templates' grams in a join (templates are
a fixed list, so their side is broadcast). A hit votes for the diagonal "place in the text minus place in the template". Votes are
added up by diagonal, diagonals next to each other (inserted or missing words) are merged, and a span counts once the words it
covers are verified to be the template's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
COVERAGE = 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
MAX_TEMPLATE_WORDS = 100_000  # all templates together: bounds the broadcast side


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    exact: bool = False  # each place counts by itself and all words must be there, one after the other


# Phrases and labels of the base count.
BASE = (Template("cc-by", "cc by", True), Template("gpl", "general public license", True), Template("reserved", "all rights reserved", True))

# Notices as their licenses give them.
NOTICES = (
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
        under the License."""),
    Template("mit", "Released under the MIT License"),
    Template("mit", "licensed under the MIT License"),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
        copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
        in all copies or substantial portions of the Software."""),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and
        the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    Template("gpl", "licensed under the GNU General Public License, version 3"),
    Template("gpl", "licensed under the GNU General Public License, version 2"),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    Template("lgpl", "GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-4.0", "Licensed under CC BY 4.0"),
    Template("cc-by", "Creative Commons Attribution 4.0 International License"),
    Template("cc0", "CC0 1.0 Universal Public Domain Dedication"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
)


def lowered(c):
    """A-Z in lower case, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def text_words(c):
    return F.regexp_extract_all(lowered(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def gram_hash(words, place, k: int):
    return F.xxhash64(F.lit(k), *(F.get(words, place + d) for d in range(k)))


def template_grams(spark, templates: tuple[Template, ...], k: int = GRAM) -> DataFrame:
    """(template, label, exact, size, width, gram, spot, said): one row for each gram place of each template."""
    rows = [(i, t.label, t.exact, t.text) for i, t in enumerate(templates)]
    t = (spark.createDataFrame(rows, "template int, label string, exact boolean, text string")
         .withColumn("w", text_words(F.col("text"))).withColumn("size", F.size("w")).filter("size > 0")
         .withColumn("width", F.least("size", F.lit(k)))
         .withColumn("spot", F.explode(F.sequence(F.lit(0), F.col("size") - F.col("width")))))
    gram = F.lit(None).cast("long")
    for n in range(1, k + 1):
        gram = F.when(F.col("width") == n, gram_hash(F.col("w"), F.col("spot"), n)).otherwise(gram)
    return t.select("template", "label", "exact", "size", "width", gram.alias("gram"), "spot",
                    F.expr("slice(w, spot + 1, width)").alias("said"))


def votes(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
          k: int = GRAM) -> DataFrame:
    """Votes by diagonal of every row, and one row with null template for each text: ``keep``, row, n_words, label,
    template, exact, size, diagonal, spots (gram places of the template that are hit), widths.

    Rows are told apart by a number of their own, so repeated and null ids stay apart. Names of ``keep`` must not be among
    these. Nothing but the hits is shuffled.
    """
    if sum(len(t.text.split()) for t in templates) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words are not meant for a broadcast")
    spark = docs.sparkSession
    grams = template_grams(spark, templates, k)
    widths = sorted({min(k, len(t.text.split())) for t in templates} | {k})
    # The last place of each text has no word; its gram 0 finds the row that stands for the text itself.
    own = spark.range(1).select(*(F.lit(0 if f.name == "gram" else None).cast(f.dataType).alias(f.name) for f in grams.schema))
    places = (docs.select(*keep, F.monotonically_increasing_id().alias("row"), text_words(F.col(text)).alias("w"))
              .select("*", F.size("w").alias("n_words"), F.posexplode(F.array_append("w", F.lit(""))).alias("place", "word")))
    keys = [F.when(F.col("place") == F.col("n_words"), F.lit(0 if n == widths[0] else None)).otherwise(
        gram_hash(F.col("w"), F.col("place"), n)) for n in widths]
    hits = (places.select("*", F.explode(F.array(*keys)).alias("gram"))
            .join(F.broadcast(grams.unionByName(own)), "gram")
            .filter(F.col("template").isNull() | (F.expr("slice(w, place + 1, width)") == F.col("said")))
            .select(*keep, "row", F.col("n_words").cast("long").alias("n_words"), "template", "label", "exact", "size", "width", "spot",
                    (F.col("place") - F.col("spot")).cast("long").alias("diagonal")))
    own_cols = [*keep, "row", "n_words", "template", "label", "exact", "size"]
    return (hits.repartition("row").groupBy(*own_cols, "width", "diagonal").agg(F.collect_set("spot").alias("spots")))


def spans(diagonals: DataFrame, keep: tuple[str, ...] = ("doc_id",), coverage: float = COVERAGE) -> DataFrame:
    """Verified spans: ``keep``, row, n_words, template, label, exact, start and end (words), score (share of the template's words).
    Rows that stand for a text stay, with null template."""
    w = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.when(F.col("exact"), F.lit(0)).otherwise(F.least(F.lit(2), F.expr("(size - 1) div 3")))
    step = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(w) > apart).cast("int"), F.lit(0))
    words_hit = F.flatten(F.transform("spots", lambda s: F.sequence(s, s + F.col("width") - 1)))
    merged = (diagonals.withColumn("step", step).withColumn("run", F.sum("step").over(w))
              .withColumn("words_hit", F.array_distinct(words_hit))
              .groupBy(*keep, "row", "n_words", "template", "label", "exact", "size", "run")
              .agg(F.min(F.col("diagonal") + F.array_min("spots")).alias("start"),
                   F.max(F.col("diagonal") + F.array_max("spots") + F.col("width")).alias("end"),
                   (F.size(F.array_distinct(F.flatten(F.collect_list("words_hit")))) / F.col("size")).alias("score")))
    return (merged.filter(F.col("template").isNull() | (F.col("score") >= F.when(F.col("exact"), F.lit(1.0)).otherwise(F.lit(coverage))))
            .select(*keep, "row", "n_words", "template", "label", "exact", "start", "end", "score"))


def scan(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """License spans of whole texts (see ``spans``); texts without any give no row. Null texts are empty."""
    return spans(votes(docs, templates, text, keep), keep).filter(F.col("template").isNotNull())


def license_digest(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES, text: str = "text",
                   keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each input row: ``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Exact templates make the base columns; empty and null texts have zeros, null words, empty labels and score 0."""
    exact = F.coalesce(F.col("exact"), F.lit(False))
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return (spans(votes(docs, templates, text, keep), keep).groupBy("row", *keep, "n_words")
            .agg(F.sum(exact.cast("long")).alias("n_base"), F.min(F.when(exact, F.col("start"))).alias("first_word"),
                 F.max(F.when(exact, F.col("start"))).alias("last_word"), joined(F.when(exact, F.col("label"))).alias("base_labels"),
                 joined(F.col("label")).alias("labels"), F.coalesce(F.max(F.when(F.col("template").isNotNull(), F.col("score"))), F.lit(0.0)).alias("score"))
            .drop("row"))

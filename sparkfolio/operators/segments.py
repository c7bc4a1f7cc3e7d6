"""Sections of flat, unpunctuated text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkfolio import lexicon as lx
from sparkfolio.functions import text as tx
from sparkfolio.functions.arrays import int_range, let

SKIP_WORDS = 3


def flat_sections(text: Column, phrases=tuple(lx.FLAT_SECTION_PHRASES)) -> Column:
    """array<struct<section,content>>: text cut at the first phrase of each section.

    The most specific phrase of a section that occurs after the third word opens it; what stands
    before the first opening is ``header``; empty contents are left out.
    """
    order: dict[str, list[list[str]]] = {}
    for section, phrase in phrases:
        order.setdefault(section, []).append(phrase.split())

    def opening(w, words):
        idx = int_range(F.lit(SKIP_WORDS + 1), F.size(w) - len(words) + 1)
        hit = lambda i: _all([F.get(w, i - 1 + k) == x for k, x in enumerate(words)])
        first = F.get(F.filter(idx, hit), F.lit(0))
        return F.when(first.isNotNull(), F.struct(first.alias("at"), F.lit(len(words)).alias("n")))

    def cut(w):
        opens = []
        for section, options in order.items():
            found = F.coalesce(*[opening(w, o) for o in options])
            opens.append(F.struct(found["at"].alias("at"), found["n"].alias("n"), F.lit(section).alias("section")))
        return let(F.sort_array(F.filter(F.array(*opens), lambda o: o["at"].isNotNull())), lambda o: build(w, o))

    def build(w, o):
        head = F.struct(F.lit("header").alias("section"), F.array_join(
            F.slice(w, F.lit(1), F.coalesce(F.get(o, F.lit(0))["at"] - 1, F.size(w))), " ").alias("content"))
        rest = F.transform(o, lambda x, j: F.struct(x["section"].alias("section"), F.array_join(F.slice(
            w, x["at"] + x["n"], F.greatest(F.lit(0), F.coalesce(F.get(o, j + 1)["at"], F.size(w) + 1) - x["at"] - x["n"])), " ").alias("content")))
        return F.filter(F.concat(F.array(head), rest), lambda c: c["content"] != "")

    return let(tx.words(text), cut)


def _all(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out

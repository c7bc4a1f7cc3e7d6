"""In-row array helpers that keep per-document work inside one row (no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EMPTY_INT = "array<int>"


def sealed(df: DataFrame) -> DataFrame:
    """Same rows and columns, but later filters are not rewritten into the column expressions.

    Record columns are long expressions built on each other; a filter pushed below them would
    copy and re-evaluate them many times.  Row-local, no shuffle.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once (lambda bodies are not shared by the optimiser)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def int_range(first: Column, last: Column) -> Column:
    """first..last inclusive, empty when last < first (``sequence`` would count down)."""
    return F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast(_EMPTY_INT))


def cut_at(arr: Column, starts: Column) -> Column:
    """Slices of ``arr`` that begin at the given 1-based positions."""
    return F.transform(starts, lambda s, j: F.slice(
        arr, s, F.coalesce(F.get(starts, j + 1), F.size(arr) + 1) - s))


def ranked_terms(tokens: Column, k: int | None = None) -> Column:
    """array<struct<term,n,pos>> of the k most frequent tokens, ties to the token seen first.

    Counts are run lengths of the row's sorted tokens, so a row never leaves its task: no explode,
    no shuffle, whatever the text length.
    """
    def runs(s):
        starts = F.filter(int_range(F.lit(1), F.size(s)), lambda b: (b == 1) | (
            F.get(s, b - 1)["t"] != F.get(s, b - 2)["t"]))
        return let(starts, lambda st: counted(s, st))

    def counted(s, st):
        ranked = F.sort_array(F.transform(st, lambda b, j: F.struct(
            (b - F.coalesce(F.get(st, j + 1), F.size(s) + 1)).alias("neg"),
            F.get(s, b - 1)["i"].alias("pos"), F.get(s, b - 1)["t"].alias("term"))))
        if k is not None:
            ranked = F.slice(ranked, 1, k)
        return F.transform(ranked, lambda r: F.struct(
            r["term"].alias("term"), (-r["neg"]).alias("n"), r["pos"].alias("pos")))

    return let(F.sort_array(F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))), runs)


def terms(ranked: Column) -> Column:
    return F.transform(ranked, lambda s: s["term"])

"""Registry of runnable queries and their ANSI-SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkfolio.catalog import derived
from sparkfolio.session import spread

_TEXT_TABLES = {"documents", "pages", "conversations"}

# Lazy plans by session and folder: saves rebuilding long expressions, holds no data.
_PLANS: dict[tuple, DataFrame] = {}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the parquet tables and to the derived record tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        key = (self.spark.sparkContext.applicationId, id(self.spark), self.sf_dir, name)
        if key not in _PLANS:
            _PLANS[key] = self._plan(name)
        return _PLANS[key]

    def _plan(self, name: str) -> DataFrame:
        if name in derived.SQL:
            sql, inputs = derived.SQL[name]
            return self.spark.sql(sql, **{i: getattr(self, i) for i in inputs})
        if name in derived.FRAMES:
            return derived.FRAMES[name](self)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in _TEXT_TABLES else df


def with_derived(sql: str, *names: str) -> str:
    """Prefix a SQL text with the derived tables it reads (dependencies included)."""
    order: list[str] = []

    def visit(n: str) -> None:
        for i in derived.SQL[n][1]:
            if i in derived.SQL:
                visit(i)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = []
    for n in order:
        body, inputs = derived.SQL[n]
        for i in inputs:
            body = body.replace("{" + i + "}", i)
        ctes.append(f"{n} AS ({body})")
    if not ctes:
        return sql
    head, tail = "WITH " + ", ".join(ctes), sql.strip()
    if tail.upper().startswith("WITH "):
        return head + ", " + tail[5:]
    return head + " " + tail


def query(name: str, oracle: str | None = None, uses: tuple[str, ...] = ()):
    """Register ``fn(tables) -> DataFrame`` with its SQL twin."""

    def wrap(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = with_derived(oracle, *uses)
        return fn

    return wrap

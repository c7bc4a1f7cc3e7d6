"""Every registered query against its SQL twin on the small tables."""

import pytest

import __spark_entry__ as entry
from sparkfolio.catalog import load
from tests.conftest import SF
from tools.check_results import compare

QUERIES, ORACLES = load()
# Results that are rightly empty on the smallest tables.
MAY_BE_EMPTY = {"w2_column_gutter"}


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ok, note, _, _ = compare(spark, duck, SF, name, QUERIES[name], ORACLES.get(name))
    assert ok or (name in MAY_BE_EMPTY and note.startswith("0 rows")), note


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "listing_id", "source", "semantic", "keyword", "structure", "overall", "rank"]
    assert df.count() > 0

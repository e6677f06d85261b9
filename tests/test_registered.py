"""Every registered query against its reference SQL on the smallest tables."""

import pytest

from millrace.plans import ORACLES, QUERIES

from .compare import compare, connect

PATH = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(PATH)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    assert compare(spark, duck, PATH, QUERIES[name], ORACLES.get(name)) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["period_bucket", "segment", "nation", "revenue", "avg_quantity", "orders", "lines"]
    assert set(e.oracle_sql()) <= set(e.queries())

"""Every catalogue query at the smallest size: equal to DuckDB, or at least some rows."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, oracle

FOLDER = "/root/testdata/sf0.001"
QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return oracle(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert difference(df, db, ORACLES[name]) is None
    else:
        assert len(df.collect()) > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1000
    assert {"flow_packets", "is_alert", "confidence"} <= set(df.columns)

"""Registered queries against their SQL at the smallest scale."""

import os

import compare
import pytest

import __spark_entry__ as entry_points
from veilscan.catalog import load

SF_DIR = os.environ.get("VEILSCAN_SF_DIR", "/root/testdata/sf0.001")
SQL = entry_points.oracle_sql()
QUERIES = {name: q.run for name, q in load().items()}


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    if name in SQL:
        assert compare.difference(con, df, SQL[name]) is None
    else:
        assert df.count() > 0


def test_entry(spark):
    assert set(SQL) <= set(entry_points.queries()) and set(QUERIES) <= set(entry_points.queries())
    assert entry_points.entry(spark).count() > 0

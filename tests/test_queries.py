"""Every query against its SQL on the smallest tables; the others must run."""

import pytest

import __spark_entry__ as entry
from sonolith.plans.registry import ORACLES, QUERIES
from tests.oracle import compare, connect

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, name, QUERIES[name], ORACLES[name], DIR) == ""
    else:
        assert QUERIES[name](spark, DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

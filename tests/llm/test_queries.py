"""The corpus queries that SQL expresses against their SQL."""

import pytest

from sonolith.llm.registry import ORACLES, QUERIES
from tests.oracle import compare, connect

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", ORACLES)
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], ORACLES[name], DIR) == ""

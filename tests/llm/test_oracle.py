"""Queries with SQL at the smallest scale."""

import os

import pytest

from paperloom.llm import queries
from tests.oracle import compare, load

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    assert compare(spark, load(DATA), DATA, name, queries.QUERIES[name], queries.SQL[name]) is None

"""Every core query against its SQL at the smallest scale."""

import os

import pytest

from paperloom import catalog
from tests.oracle import compare, load

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return load(DATA)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query(spark, con, name):
    assert compare(spark, con, DATA, name, catalog.QUERIES[name], catalog.SQL[name]) is None


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())

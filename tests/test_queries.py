"""Every registered query against its SQL, on the smallest test tables."""

import os

import pytest

from compare import compare, connect
from docpipe.registry import all_queries, all_sql

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, QUERIES[name], SQL.get(name), SF_DIR) is None


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)

"""Every named query against its SQL twin on the smallest tables."""

import os

import pytest

from parity import compare, connect
from tillview.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.all_queries(), registry.all_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in SQL:
        assert compare(spark, duck, name, QUERIES[name], SQL[name], FOLDER) is None
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0

"""Every registered query against its SQL, at the smallest scale."""

import pytest

from corpus_audit import plans
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLE = plans.load()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    ok, text, _ = compare(spark, con, FOLDER, name, QUERIES[name], ORACLE.get(name))
    assert ok, text

"""Every query of the catalog against its SQL twin on the smallest data."""

import pytest

import __spark_entry__ as entry
from seatflow import catalog
from seatflow.catalog import learning
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.all_queries(), catalog.all_sql()
TREES = 20


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.fixture(scope="module", autouse=True)
def fewer_trees():
    """Training takes minutes with all trees; that is left to the registered queries themselves."""
    whole, learning.PARAMS = learning.PARAMS, learning.D.Params(trees=TREES)
    yield
    learning.PARAMS = whole
    learning._TRAINED.clear()
    learning._PREDICTED.clear()


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_answer(spark, con, name):
    sql = SQL[name].replace("'300' AS trees", f"'{TREES}' AS trees")
    assert compare(spark, con, SF, QUERIES[name], sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())

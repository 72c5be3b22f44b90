"""Every registered query against its SQL, on whole tables."""

import pytest

import __spark_entry__ as entry_points
from oracle import connect, differences
from pagecatalog.plans.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    assert entry_points.entry(spark).columns == ["link", "page_id", "pos"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = entry_points.queries()[name](spark, FOLDER)
    assert differences(df, con, entry_points.oracle_sql()[name]) == []

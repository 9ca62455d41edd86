"""Every registered query against its SQL, over whole tables."""

import os

import pytest

import __spark_entry__ as entry_points
from compare import connect, differences
from loglake.plans.catalog import registered_queries
from loglake.plans.oracle import oracles

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

QUERIES = registered_queries()
ORACLES = oracles()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and rows[0]["n"] >= rows[-1]["n"]


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, name):
    assert differences(QUERIES[name](spark, SF_DIR), duck, ORACLES[name]) == []

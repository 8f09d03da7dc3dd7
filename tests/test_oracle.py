"""Every registered query against its SQL, on the smallest tables."""

import pytest

import oracle
from __spark_entry__ import entry
from tallybook.plans.registry import queries
from tallybook.plans.star_sql import oracle_sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_equals_sql(spark, connection, name):
    assert oracle.differences(queries()[name](spark, FOLDER), connection, oracle_sql()[name]) == {}


def test_every_query_has_sql():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    assert entry(spark).columns == ["account", "tc_commodity_final", "total"]

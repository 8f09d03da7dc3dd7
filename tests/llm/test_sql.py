"""Queries that SQL can express against their SQL, on the smallest tables."""

import pytest

import oracle
from tallybook.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert oracle.differences(queries.queries()[name](spark, SF), oracle.connect(SF), queries.oracle_sql()[name]) == {}

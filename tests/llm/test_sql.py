"""Queries that SQL can express, against DuckDB."""

import pytest
from comparing import by_duckdb, by_spark

from quern.llm.oracles import ORACLES
from quern.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, small, name):
    assert by_spark(QUERIES[name](spark, small)) == by_duckdb(ORACLES[name], small)

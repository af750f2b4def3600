"""Every query of the library against its SQL counterpart; those without one must run and repeat."""

import pytest
from comparing import by_duckdb, by_spark

from quern import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_equals_sql(spark, small, name):
    assert by_spark(plans.QUERIES[name](spark, small)) == by_duckdb(plans.ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_repeats(spark, small, name):
    first = by_spark(plans.QUERIES[name](spark, small))
    assert first[1] and first == by_spark(plans.QUERIES[name](spark, small))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "vec_id", "score", "rank"]
    assert set(plans.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

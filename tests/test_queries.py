"""Every core query against its SQL."""

import pytest

from gyral.queries import oracle_sql, queries
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_against_sql(spark, sf, name):
    same(spark, queries(), oracle_sql(), name, sf)


def test_every_query_is_checked():
    assert set(queries()) == set(oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

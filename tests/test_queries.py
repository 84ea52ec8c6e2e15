"""Every registered query against its SQL, on the smallest data."""

import pytest
from compare import compare, connection

from checks import ORACLES, QUERIES


@pytest.fixture(scope="module")
def database(folder):
    return connection(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(name, spark, folder, database):
    assert compare(QUERIES[name](spark, folder), database, ORACLES[name]) is None


def test_entry_returns_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.queries()) >= set(QUERIES)
    assert __spark_entry__.oracle_sql().items() >= ORACLES.items()

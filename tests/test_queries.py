"""Every registered query against its SQL in another engine, on the smallest data."""

import pytest
from compare import connect, differences
from conftest import SF_SMALL

from __spark_entry__ import entry, oracle_sql, queries


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    df = queries()[name](spark, SF_SMALL)
    sql = oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        # One unit in the last rounded digit.
        assert differences(df, con, sql, tolerance=1.5e-6) == []


def test_entry(spark):
    assert entry(spark).count() == 10

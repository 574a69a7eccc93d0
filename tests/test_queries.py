"""Every registered query against its SQL statement on the smallest data folder."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    if name in SQL:
        assert difference(df, con, SQL[name]) is None
    else:
        df.count()

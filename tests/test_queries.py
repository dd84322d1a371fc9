"""Every registered query of the library against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from claimloom.queries import ORACLE_SQL, QUERIES
from tests.oracle import assert_same


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, name):
    df = QUERIES[name](spark, sf)
    if name in ORACLE_SQL:
        assert_same(df, ORACLE_SQL[name], sf)
    else:
        assert df.count() > 0


def test_entry_point(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

"""Every registered query of the reference's operators runs; those with SQL give the SQL's rows."""

import pytest

from folia.plans.registry import QUERIES, SQL
from tests.sql import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    if name in SQL:
        assert_same(df, SQL[name], small)
    else:
        assert df.columns
        df.count()


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0

"""Every query with SQL gives its SQL's rows; every other query gives rows."""

import pytest
from compare import connect, same_rows

from quire.plans.all_queries import QUERIES, SQL


#: Some queries compare pages of at least 30 rows, which the smallest tables do not have.
TABLES = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    same_rows(QUERIES[name](spark, TABLES), connect(TABLES), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, TABLES).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

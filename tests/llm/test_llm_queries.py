import pytest
from compare import connect, same_rows

from quire.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_sql(spark, small, name):
    same_rows(QUERIES[name](spark, small), connect(small), ORACLE_SQL[name])


def test_registered():
    import __spark_entry__ as e

    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(e.queries())

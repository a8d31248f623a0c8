"""Every core query against its SQL, on the smallest tables."""

import pytest

from quillmill.plans.catalog import oracle_sql, queries
from tests.compare import connect, spark_rows, sql_rows

SQL = oracle_sql()


@pytest.fixture(scope="module")
def duck(data):
    return connect(f"{data}/sf0.001")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, duck, data, name):
    got, want = spark_rows(queries()[name](spark, f"{data}/sf0.001")), sql_rows(duck, SQL[name])
    assert got[0] == want[0] and got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(queries()) - set(SQL)))
def test_queries_without_sql_run(spark, data, name):
    assert queries()[name](spark, f"{data}/sf0.001").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["section", "total", "kept", "dropped"]
    assert set(SQL) <= set(e.oracle_sql()) <= set(e.queries())

import pytest
from comparing import duck, same

from tallywing import registered

QUERIES, SQL = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def database(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, small, database, name):
    same(QUERIES[name](spark, small), database, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_has_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0

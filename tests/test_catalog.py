import pytest

from tessera.plans import catalog
from tests.oracle import SMALL, connect, same

SQL = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    same(catalog.queries()[name](spark, SMALL), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() > 0

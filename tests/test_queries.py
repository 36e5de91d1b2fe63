import pytest

from statloom.plans import oracle, queries

from .oracle import SF, connect, same

SQL, ALL = oracle.oracle_sql(), queries.queries()


@pytest.fixture(scope="module")
def duck():
    return connect()


def test_every_statement_has_a_query():
    assert set(SQL) == set(ALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    same(ALL[name](spark, SF), SQL[name], duck)


import pytest

from statloom.llm import queries

from ..oracle import SF, connect, same


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], connect())

import pytest

from reelspark.llm import queries
from tests.compare import DATA, by_spark, by_sql, tables


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    assert by_spark(queries.queries()[name](spark, DATA)) == by_sql(tables(), queries.oracle_sql()[name])

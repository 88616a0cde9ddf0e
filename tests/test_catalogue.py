import pytest

from reelspark.plans import catalogue
from tests.compare import DATA, by_spark, by_sql, tables

SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return tables()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert by_spark(catalogue.queries()[name](spark, DATA)) == by_sql(con, SQL[name])


def test_entry_points(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_no_operator_collects():
    import pathlib

    import reelspark

    top = pathlib.Path(reelspark.__file__).parent
    for part in ("operators", "sources", "functions", "plans", "streaming"):
        for path in (top / part).glob("*.py"):
            assert not {".collect()", "toPandas(", ".rdd"} & {x for x in (".collect()", "toPandas(", ".rdd") if x in path.read_text()}, path

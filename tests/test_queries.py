import pytest

from conftest import SMALL, same_rows
from lithoscope.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_agrees_with_sql(spark, duck, name):
    assert same_rows(QUERIES[name](spark, SMALL), duck.sql(ORACLE_SQL[name]))

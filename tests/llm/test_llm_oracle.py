import pytest

from larkspur.llm import queries
from oracle import differences


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert differences(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001") == ""

import pytest

from larkspur.plans import catalogue
from oracle import differences


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert differences(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name], "/root/testdata/sf0.001") == ""

import pytest
from helpers import assert_matches

from loomspark import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    assert_matches(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name])

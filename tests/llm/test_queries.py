import pytest

from passagemill.llm import queries
from tests.test_queries import compare


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, small, name):
    compare(spark, small, name, queries.QUERIES[name], queries.ORACLES.get(name))



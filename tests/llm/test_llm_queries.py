import pytest

from gridloom.llm import queries
from tests.test_queries import compare, duck  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):  # noqa: F811
    compare(spark, duck, name)

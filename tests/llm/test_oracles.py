import pytest

from repovitals.llm import queries
from tests.oracle import differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(queries.queries()[name](spark, SMALL), queries.oracle_sql()[name], SMALL) == ""

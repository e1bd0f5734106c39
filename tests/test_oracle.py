import pytest

from repovitals.plans import catalog
from tests.oracle import differences

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert differences(catalog.queries()[name](spark, SMALL), catalog.oracle_sql()[name], SMALL) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_run(spark, name):
    assert catalog.queries()[name](spark, SMALL).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns[:3] == ["file", "complexity", "churn"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

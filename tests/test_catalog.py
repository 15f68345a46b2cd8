import __spark_entry__
import pytest
from evidloom.plans import catalog
from oracle import check


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_equals_sql(spark, name):
    d = "/root/testdata/sf0.01"
    check(catalog.queries()[name](spark, d), d, catalog.oracle_sql()[name])


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 8
    assert set(catalog.queries()) <= set(__spark_entry__.queries())

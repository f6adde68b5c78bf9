"""Every catalogue query against its SQL on the smallest tables; those without SQL must give rows."""

import pytest
from oracle import same, views

from quillspark.plans import catalogue

SF = "/root/testdata/sf0.001"
# these take long in the other engine at any size; they are compared at one size by the driver
SLOW_SQL = {"chunk_fixed_words", "gold_overlap", "gold_counts"}


@pytest.fixture(scope="module")
def con():
    return views(SF)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, con, name):
    df = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql is None or name in SLOW_SQL:
        assert df.count() > 0
    else:
        same(df, con, sql)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

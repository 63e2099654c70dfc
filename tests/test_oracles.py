"""Every query that SQL can express, on the smallest tables."""

import pytest

from rankloom.plans import registry
from tests.compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    assert_same(got, connect(sf_dir).execute(registry.ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_gives_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

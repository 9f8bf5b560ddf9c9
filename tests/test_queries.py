"""Every registered query of the document operators against its SQL."""
import pytest

from papyrine.plans import registry
from tests.harness import connect, rows

WITH_SQL = sorted(registry.oracle_sql())
WITHOUT_SQL = sorted(set(registry.queries()) - set(WITH_SQL))


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", WITH_SQL)
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_query_runs(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

import pytest

from meshwork.plans import catalog, stored

from .oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, name):
    assert name in catalog.ORACLE
    compare(spark, catalog.QUERIES[name], catalog.ORACLE[name])


def test_stored_queries_are_registered():
    assert stored.QUERIES_HERE <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["v", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

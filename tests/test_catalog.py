"""Every registered query against its SQL."""

import pytest
from oracle import connection, rows

from bayesloom import catalog, catalog_models, catalog_reports, catalog_workloads  # noqa: F401  the others add their queries to the first

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows_as_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    want = duck.execute(catalog.SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql():
    """Those that tests hold against plain versions."""
    assert set(catalog.QUERIES) - set(catalog.SQL) == {"k02_diverse_selection"}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())

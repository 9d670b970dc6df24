"""Every query with SQL gives the rows of its SQL; the others run and keep their contracts."""

import pytest

from panelyard import queries as panel


@pytest.mark.parametrize("name", sorted(panel.SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(panel.QUERIES[name], panel.SQL[name])


@pytest.mark.parametrize("name", sorted(set(panel.QUERIES) - set(panel.SQL)))
def test_query_without_sql_runs(name, spark, sf_dir):
    df = panel.QUERIES[name](spark, sf_dir)
    assert df.columns and df.count() >= 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

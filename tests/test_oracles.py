"""Every registered query with SQL equals DuckDB; the others run and keep their schema."""

import pytest

from wardline.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_oracle(name, same):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_oracle_has_rows(name, spark, sf_dir):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    row = e.entry(spark).first()
    assert row.total > 0 and 0 < row.kmpp < 10 and row.min_pop <= row.median <= row.max_pop

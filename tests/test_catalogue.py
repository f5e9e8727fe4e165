"""Every query against its SQL in DuckDB, at the smallest scale."""

import pytest

from loomwork.plans import catalogue

from .conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, duck, sf, name):
    got = catalogue.QUERIES[name](spark, sf).toPandas()
    same_rows(got, duck.sql(catalogue.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry_has_rows_and_a_stable_schema(spark):
    import __spark_entry__ as e

    a, b = e.entry(spark), e.entry(spark)
    assert a.schema == b.schema and a.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

import pytest
from compare import duck_rows, rows_of
from conftest import SF

from loomspan.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_duckdb(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF)) == duck_rows(duck, ORACLE[name])


def test_every_query_has_an_oracle_or_runs(spark):
    for name in sorted(set(QUERIES) - set(ORACLE)):
        assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

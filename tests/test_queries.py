"""Every query of the library against its SQL over the smallest tables."""

import pytest

import __spark_entry__ as entry
from boardlens.plans import registry
from tests.compare import oracle_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_its_sql(spark, name):
    got = spark_rows(registry.QUERIES[name](spark, FOLDER))
    assert got == oracle_rows(SQL[name], FOLDER)


def test_entry_names_a_query_with_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

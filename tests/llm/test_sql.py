"""Text queries that SQL can express, against their SQL."""

import pytest

from boardlens.llm import queries
from tests.compare import oracle_rows, spark_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    assert spark_rows(queries.QUERIES[name](spark, folder)) == oracle_rows(queries.ORACLES[name], folder)

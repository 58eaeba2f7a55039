"""The queries that have SQL against DuckDB on the smallest tables."""

import pytest

from tests.conftest import SF
from tests.test_queries import rows
from tracewright.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    got = duck.execute(queries.SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())

"""Every registered query of the engine against its DuckDB SQL on the smallest tables."""

import math

import pytest

from tests.conftest import SF
from tracewright.plans import registry

SQL = registry.oracle_sql()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        return str(x)
    return round(float(x), 6)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = duck.execute(SQL[name])
    columns = [c[0] for c in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, got.fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0

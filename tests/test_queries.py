"""Every registered query that has SQL gives the same rows as DuckDB on the same tables."""

import math
import os

import duckdb
import pytest

from docketspark.plans.registry import QUERIES, SQL

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    result = duck.execute(SQL[name])
    columns = [x[0] for x in result.description]
    assert sorted(columns) == sorted(df.columns)
    places = [columns.index(c) for c in sorted(columns)]
    want = sorted(tuple(shown(r[i]) for i in places) for r in result.fetchall())
    assert sorted(tuple(shown(r[c]) for c in sorted(columns)) for r in df.collect()) == want


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())

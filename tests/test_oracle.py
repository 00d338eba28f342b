"""Every time-series query against its SQL on DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest
from tidewright import queries

from conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return round(v, 7) if isinstance(v, float) else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = duck.sql(queries.ORACLE[name])
    assert sorted(df.columns) == sorted(found.columns)
    ours, theirs = rows(df.columns, df.collect()), rows(found.columns, found.fetchall())
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-6)) for x, y in zip(a, b, strict=True)), (a, b)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_value_predicate_reaches_the_parquet_scan(spark):
    plan = queries.QUERIES["agg_by_series_pred"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,50.0)" in plan
    assert "props" not in plan.split("ReadSchema")[1].splitlines()[0]

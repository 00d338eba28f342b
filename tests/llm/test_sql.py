"""Queries of the training-data operators against their SQL."""

from pathlib import Path

import duckdb
import pytest
from tidewright.llm import queries

from conftest import TINY
from test_oracle import rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for p in Path(TINY).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df, found = queries.QUERIES[name](spark, TINY), con.sql(queries.ORACLE[name])
    assert rows(df.columns, df.collect()) == rows(found.columns, found.fetchall())

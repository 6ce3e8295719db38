"""The training-data queries that SQL can express against DuckDB."""

import duckdb
import pytest

from tessera.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(ORACLES[name])
    cols = want.columns
    df = QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(cols)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))

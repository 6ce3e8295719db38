"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pytest

import tessera.plans.queries  # noqa: F401
from tessera.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    if name not in ORACLES:
        assert got
        return
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_replies_about_the_limit(spark, tmp_path):
    n = 8192
    texts = ["a b the c", "w " * (n - 1) + "w", "w " * n + "w", "w " * (n + 50) + "de", "w " * n + "the x", "the", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["token_stream"](spark, str(tmp_path))
    want = con.sql(ORACLES["token_stream"])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())
    assert {r.doc_id for r in df.collect()} == {0, 1, 4}

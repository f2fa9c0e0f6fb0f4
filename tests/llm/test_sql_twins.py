"""Queries of the package that SQL can express, against their twins."""

import duckdb
import pytest

from sondage.llm import queries

D = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{D}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_sql(spark, duck, name):
    df = queries.queries()[name](spark, D)
    want = duck.sql(queries.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    # as text, since rows hold nulls and texts: sorted rows need one order
    got = sorted(tuple(str(r[c]) for c in columns) for r in df.collect())
    assert got == sorted(tuple(str(r[i]) for i in place) for r in want.fetchall())

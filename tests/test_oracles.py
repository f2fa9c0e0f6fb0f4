"""Every registered query against its SQL twin, over the smallest shared tables."""

import glob
import math
import os

import duckdb
import pytest

from sondage.plans import registry

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def norm(v):
    return ("nan" if math.isnan(v) else repr(v + 0.0)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_rows_equal_sql(spark, duck, name):
    df = registry.queries()[name](spark, D)
    want = duck.sql(registry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    place = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(norm(r[i]) for i in place) for r in want.fetchall())

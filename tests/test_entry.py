"""Every query with SQL equals it on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    cell = lambda v: "null" if v is None else f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else repr(v)
    got = entry.queries()[name](spark, DIR)
    want = con.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(tuple(map(cell, r)) for r in want.fetchall())
    assert sorted(tuple(map(cell, r)) for r in got.select(*(f"`{c}`" for c in columns)).collect()) == rows


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0

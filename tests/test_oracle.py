"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pytest

from ledgerloom import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    names = sorted(frame.columns)
    got = sorted((tuple(r[c] for c in names) for r in frame.collect()), key=str)
    result = duck.execute(registry.oracle_sql()[name])
    order = [[d[0] for d in result.description].index(c) for c in names]
    assert got == sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=str)


def test_every_query_has_sql():
    assert set(registry.queries()) - set(registry.oracle_sql()) == set()

"""Every query with SQL against that SQL, over the smallest tables; names and columns of all."""

import glob
import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")


def _norm(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(k for k in entry.registry.SQL))
def test_equal_to_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    run = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in run.description]
    assert sorted(names) == columns
    want = sorted((tuple(_norm(r[names.index(c)]) for c in columns) for r in run.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["event_uid", "place_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())

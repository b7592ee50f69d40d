"""The SQL of this subpackage's queries against the operators, over the smallest tables."""

import glob
import os

import pytest

from quakeloom.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equal_to_sql(spark, name):
    c = pytest.importorskip("duckdb").connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    run = c.execute(queries.SQL[name])
    names = [x[0] for x in run.description]
    got = queries.QUERIES[name](spark, DATA).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(run.fetchall())

import os

import pytest
from pyspark.sql import functions as F

from quakeloom.operators.picklists import with_window
from quakeloom.streaming.picks import counts_by_window, windowed_pairs

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")


def _stream(spark, name, tmp_path):
    batch = spark.read.parquet(f"{DATA}/{name}.parquet")
    folder = str(tmp_path / name)
    batch.repartition(3).write.parquet(folder)
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _all(df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
        return df.sparkSession.table(name).collect()
    finally:
        query.stop()


def test_stream_join_equals_the_batch_join(spark, tmp_path):
    picks, pick_stream = _stream(spark, "temp_pick", tmp_path)
    events, event_stream = _stream(spark, "catalog_event", tmp_path)
    named = lambda p: p.select(F.col("temp_id").alias("pick"), "arrival_ts")
    got = _all(windowed_pairs(named(pick_stream), event_stream.select("event_uid", "event_dt"), "400 days"), "pairs")
    p = named(picks).select("pick", F.unix_micros("arrival_ts").alias("us"))
    want = with_window(p, events.select("event_uid", F.unix_micros("event_dt").alias("origin"))).select("pick", "event_uid").collect()
    assert sorted((r.pick, r.event_uid) for r in got) == sorted((r.pick, r.event_uid) for r in want)


def test_window_counts(spark, tmp_path):
    picks, stream = _stream(spark, "temp_pick", tmp_path)
    got = {(r.window.start, r.code): r.n for r in _all(counts_by_window(stream, "400 days"), "counts", "complete")}
    want = {(r.window.start, r.code): r.n for r in counts_by_window(picks).collect()}
    assert got == want

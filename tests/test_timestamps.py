import datetime as dt
from zoneinfo import ZoneInfo

import pytest

from quakeloom.operators import timestamps
from quakeloom.session import new_stage_path

SOURCES = [("LDG", "Europe/Paris", "dmy"), ("RESIF", "UTC", "ymd"), ("FIELDCAM", "Europe/Paris", "mdy")]


def _us(text):
    return round(dt.datetime.fromisoformat(text).timestamp() * 1e6)


def _run(spark, rows, path=None):
    raw = spark.createDataFrame(rows, "raw_id bigint, source string, event_dt string, received_ts timestamp")
    sources = spark.createDataFrame(SOURCES, "source string, time_zone string, date_order string")
    return {r.raw_id: r.utc_us for r in timestamps.to_instants(raw, sources, path).collect()}


CASES = [
    ("RESIF", "2021-08-21T14:36:35.957700Z", "2021-08-21T14:36:35.957700+00:00"),
    ("LDG", "2021-08-21 14:36:35", "2021-08-21T12:36:35+00:00"),
    ("LDG", "04/03/2021 10:00:00", "2021-03-04T09:00:00+00:00"),
    ("FIELDCAM", "04/03/2021 10:00:00 PM", "2021-04-03T20:00:00+00:00"),
    ("FIELDCAM", "04/03/2021 12:30:00 AM", "2021-04-02T22:30:00+00:00"),
    ("RESIF", "21/03/04 10:00:00.25", "2021-03-04T10:00:00.250000+00:00"),
    ("LDG", "04/03/21 10:00:00", "2021-03-04T09:00:00+00:00"),
    ("RESIF", "2021.063.10.00.05.5", "2021-03-04T10:00:05.500000+00:00"),
    ("RESIF", "2021-063T10:00:05Z", "2021-03-04T10:00:05+00:00"),
    ("RESIF", "20210304 1000 05.25", "2021-03-04T10:00:05.250000+00:00"),
    ("RESIF", "20210304T100005.25Z", "2021-03-04T10:00:05.250000+00:00"),
    ("RESIF", "2021 3 4 10 0 5.25", "2021-03-04T10:00:05.250000+00:00"),
    ("LDG", "1er mars 2021 15h38m20,5s", "2021-03-01T14:38:20.500000+00:00"),
    ("LDG", "31 de octubre de 2021, 04:59:59,28", "2021-10-31T03:59:59.280000+00:00"),
    ("LDG", "05-Dec-2021 07:21:17.18 CET", "2021-12-05T06:21:17.180000+00:00"),
    ("RESIF", "Aug 18, 2024 01:33:54", "2024-08-18T01:33:54+00:00"),
    ("LDG", "2021-03-04 10:00:00 TU", "2021-03-04T10:00:00+00:00"),
    ("LDG", "2021-03-04 10:00:00-03:30", "2021-03-04T13:30:00+00:00"),
    ("LDG", "2021-03-04T10:00:00 +0545", "2021-03-04T04:15:00+00:00"),
    ("LDG", "1614852000", "2021-03-04T10:00:00+00:00"),
    ("LDG", "1614852000.5", "2021-03-04T10:00:00.500000+00:00"),
    ("LDG", "1614852000500", "2021-03-04T10:00:00.500000+00:00"),
    ("LDG", "1614852000500001", "2021-03-04T10:00:00.500001+00:00"),
    ("RESIF", "2021-12-31 24:05:60", "2022-01-01T00:06:00+00:00"),
    ("LDG", "2021-03-28 02:30:00", "2021-03-28T01:30:00+00:00"),  # never occurs: the offset before the change
]
UNUSABLE = [None, "", "None", "pending", "31/02/2021 10:00:00", "2021-13-04T01:02:03Z", "2022-06-31 25:61:00", "0000-00-00T00:00:00Z", "9" * 60_000]


def test_writings(spark):
    got = _run(spark, [(i, s, t, None) for i, (s, t, _) in enumerate(CASES)])
    for i, (_, text, want) in enumerate(CASES):
        assert got[i] == _us(want), text


def test_unusable_texts_and_sources(spark):
    got = _run(spark, [(i, "LDG", t, None) for i, t in enumerate(UNUSABLE)] + [(99, "nobody", "2021-03-04 10:00:00", None), (98, None, "1614852000", None)])
    assert all(got[i] is None for i in range(len(UNUSABLE))) and got[99] is None
    assert got[98] == 1614852000000000


@pytest.mark.parametrize("received, offset", [("2021-10-31T00:40:00", 2), ("2021-10-31T02:00:00", 1), (None, 2)])
def test_a_time_that_occurs_twice(spark, received, offset):
    at = dt.datetime.fromisoformat(received) if received else None
    got = _run(spark, [(1, "LDG", "2021-10-31 02:30:00", at)])
    assert got[1] == _us(f"2021-10-31T02:30:00+0{offset}:00")


def test_against_zoneinfo(spark):
    zone = ZoneInfo("Europe/Paris")
    start = dt.datetime(2021, 3, 27, 22, tzinfo=dt.UTC)
    instants = [start + dt.timedelta(minutes=7 * i) for i in range(300)]
    got = _run(spark, [(i, "LDG", t.astimezone(zone).strftime("%d-%m-%Y %H:%M:%S"), None) for i, t in enumerate(instants)])
    assert all(got[i] == round(t.timestamp() * 1e6) for i, t in enumerate(instants))


def test_the_dictionary_grows(spark):
    path = new_stage_path(spark, "test-instants")
    _run(spark, [(1, "LDG", "2021-03-04 10:00:00", None), (2, "LDG", "2021-03-04 10:00:00", None)], path)
    assert spark.read.parquet(path).count() == 1
    got = _run(spark, [(1, "LDG", "2021-03-04 10:00:00", None), (3, "RESIF", "2021-03-04 10:00:00", None)], path)
    assert spark.read.parquet(path).count() == 2
    assert got[1] + 3_600_000_000 == got[3]
    assert _run(spark, [(1, "LDG", None, None)], path) == {1: None}


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    raw = spark.createDataFrame([(1, "RESIF", "1614852000", None)], "raw_id bigint, source string, event_dt string, received_ts timestamp")
    for c in ("utc_us", "time_zone", "_tz", "_row", "first_us"):
        raw = raw.withColumn(c, F.lit("x"))
    sources = spark.createDataFrame(SOURCES, "source string, time_zone string, date_order string").withColumn("event_dt", F.lit("y"))
    r = timestamps.to_instants(raw, sources).first()
    assert (r.utc_us, r.time_zone, r["_tz"]) == (1614852000000000, "x", "x")

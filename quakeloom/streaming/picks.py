"""Picks matched to events as both arrive: a stream-stream join on time buckets with watermarks.

The batch operator's interval join (an event at most a minute before the pick) for data
that arrive late and out of order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_S = 60


def windowed_pairs(picks: DataFrame, events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(pick, event_uid, lag_s) of streams picks (pick, arrival_ts) and events (event_uid, event_dt).

    The equi-key is the minute; events are sent to their minute and the next, so that a window of
    60 s is met. Both watermarks and the bound between the times let the engine drop old state.
    """
    minute = lambda c: F.floor(F.unix_micros(c) / (WINDOW_S * 1_000_000))
    left = picks.where(F.col("arrival_ts").isNotNull()).withWatermark("arrival_ts", late).withColumn("_m", minute("arrival_ts"))
    right = events.where(F.col("event_dt").isNotNull()).withWatermark("event_dt", late)
    right = right.withColumn("_k", F.explode(F.array(minute("event_dt"), minute("event_dt") + 1)))
    bound = (F.col("arrival_ts") >= F.col("event_dt")) & (F.col("arrival_ts") <= F.col("event_dt") + F.expr(f"INTERVAL {WINDOW_S} SECONDS"))
    pairs = left.join(right, (F.col("_m") == F.col("_k")) & bound)
    lag = (F.unix_micros("arrival_ts") - F.unix_micros("event_dt")) / 1e6
    return pairs.select("pick", "event_uid", lag.alias("lag_s"))


def counts_by_window(picks: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Picks by code and tumbling window of arrival, with a watermark."""
    timed = picks.where(F.col("arrival_ts").isNotNull()).withWatermark("arrival_ts", late)
    return timed.groupBy(F.window("arrival_ts", width), "code").agg(F.count("*").alias("n"))

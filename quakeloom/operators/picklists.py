"""Lists of phase picks: duplicates, overrides, order, and picks matched to events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.functions.geo import haversine_km
from quakeloom.functions.seismic import interpolated
from quakeloom.operators.bands import band_join

TABLE_STEP_KM = 0.5
SLACK_S = 2.5
TOLERANCE_S = {"P": 0.1, "S": 0.3}


def _key(phase: Column) -> Column:
    return F.substring(phase, 1, 1)


def first_picks(picks: DataFrame) -> DataFrame:
    """The first pick (by pick_seq, then pick_id) of each event, code and phase letter."""
    order = F.struct("pick_seq", "pick_id")
    keys = ["event_uid", "code", _key(F.col("phase")).alias("letter")]
    return picks.groupBy(*keys).agg(F.min(order).alias("f")).select("event_uid", "code", "letter", "f.pick_seq", "f.pick_id")


def overridden(picks: DataFrame) -> DataFrame:
    """Of each event, code and phase letter the last pick, at the place of the first."""
    order = F.struct("pick_seq", "pick_id")
    keys = ["event_uid", "code", _key(F.col("phase")).alias("letter")]
    return picks.groupBy(*keys).agg(F.min("pick_seq").alias("place"), F.max(order).alias("l")).select("event_uid", "code", "letter", "place", "l.pick_id")


def ordered_picks(picks: DataFrame) -> DataFrame:
    """(pick_id, event_uid, place): picks of each event by arrival, those without one last, else as they stand."""
    w = Window.partitionBy("event_uid").orderBy(F.col("us").asc_nulls_last(), "pick_seq", "pick_id")
    return picks.select("pick_id", "event_uid", F.row_number().over(w).alias("place"))


def merged_phases(groups: DataFrame, picks: DataFrame) -> DataFrame:
    """(group_id, pick_id): picks of merged doubles, those of the kept event first, each code and phase letter once.

    groups: id, group_id; the kept event is the one whose id is group_id.
    """
    rank = F.when(F.col("event_uid") == F.col("group_id"), 0).otherwise(1)
    own = picks.join(groups.select(F.col("id").alias("event_uid"), "group_id"), "event_uid")
    order = F.struct(rank.alias("r"), F.col("event_uid"), F.col("pick_seq"), F.col("pick_id"))
    best = own.groupBy("group_id", "code", _key(F.col("phase")).alias("letter")).agg(F.min(order).alias("b"))
    return best.select("group_id", "b.pick_id")


def travel_time_table(observed: DataFrame, max_km: float, step_km: float = TABLE_STEP_KM, width_km: float = 5.0) -> DataFrame:
    """(k, distance, tp_low, tp_high, ts_low, ts_high): envelope of observed travel times every step_km.

    observed: km, letter (P or S), tt. Each row is the least and greatest time of the
    observations within width_km; distances without observations of both phases are null there.
    """
    reach = round(width_km / step_km)
    k = F.floor(F.col("km") / step_km).cast("int")
    near = observed.where(F.col("km").between(0, max_km + width_km) & (F.col("tt") >= 0)).select(
        "letter", "tt", F.explode(F.sequence(F.greatest(k - reach, F.lit(0)), k + reach)).alias("k")
    )
    p, s = F.col("letter") == "P", F.col("letter") == "S"
    rows = near.where(F.col("k") <= round(max_km / step_km)).groupBy("k").agg(
        F.min(F.when(p, F.col("tt"))).alias("tp_low"), F.max(F.when(p, F.col("tt"))).alias("tp_high"),
        F.min(F.when(s, F.col("tt"))).alias("ts_low"), F.max(F.when(s, F.col("tt"))).alias("ts_high"),
    )
    return rows.select("k", (F.col("k") * step_km).alias("distance"), "tp_low", "tp_high", "ts_low", "ts_high")


def with_window(picks: DataFrame, events: DataFrame, window_us: int = 60_000_000) -> DataFrame:
    """Pairs of a pick (pick, us, ...) and an event (event_uid, origin, ...) at most window_us before it, both ends included."""
    return band_join(picks, events, "us", "origin", -window_us, 0)


def matched_picks(picks: DataFrame, events: DataFrame, stations: DataFrame, table: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(pick, status, event_uid) for every pick: matched, or the first reason against it.

    picks: pick, us, code, letter, ord (the order of files and within them, so that files chained one
    after the other are one pass). existing: event_uid, code, letter of the picks that events have already. events: event_uid, origin, lat, lon. stations: code,
    latitude, longitude. table: as travel_time_table. Statuses in order: no_event (none within
    a minute before), no_station, no_residual (no event whose travel time fits the band),
    multi (several fit), duplicate (an earlier or existing pick has the event, code and letter), matched.
    The table has a row for each step up to its greatest distance, some hundred.
    """
    rows = F.sort_array(F.collect_list(F.struct("k", "tp_low", "tp_high", "ts_low", "ts_high")))
    whole = table.agg(rows.alias("_table"))  # one row of a few hundred structs
    at = stations.groupBy("code").agg(F.min(F.struct("site_id", "latitude", "longitude")).alias("_s"))
    near = with_window(picks, events.select("event_uid", "origin", "lat", "lon"))
    near = near.join(at, "code", "left").join(F.broadcast(whole))
    near = near.withColumn("_km", haversine_km(F.col("lat"), F.col("lon"), F.col("_s.latitude"), F.col("_s.longitude")))
    tt = (F.col("us") - F.col("origin")) / 1e6
    band = lambda e: F.when(F.col("letter") == "P", interpolated(F.col("_km"), F.col("_table"), f"tp_{e}", TABLE_STEP_KM)).otherwise(
        interpolated(F.col("_km"), F.col("_table"), f"ts_{e}", TABLE_STEP_KM)
    )
    slack = F.when(F.col("letter") == "P", TOLERANCE_S["P"]).otherwise(TOLERANCE_S["S"]) + SLACK_S
    fits = F.coalesce(tt.between(band("low") - slack, band("high") + slack), F.lit(False))
    seen = near.groupBy("pick").agg(
        F.max(F.col("_s").isNotNull()).alias("placed"),
        F.count(F.when(fits, 1)).alias("n_fit"),
        F.min(F.when(fits, F.col("event_uid"))).alias("event_uid"),
    )
    told = picks.join(seen, "pick", "left").withColumn(
        "reason",
        F.when(F.col("placed").isNull(), "no_event")
        .when(~F.col("placed"), "no_station")
        .when(F.col("n_fit") == 0, "no_residual")
        .when(F.col("n_fit") > 1, "multi"),
    )
    held = F.lit(None).cast("boolean")
    if existing is not None:
        keys = ["event_uid", "code", "letter"]
        told = told.join(existing.select(*keys).dropna().distinct().withColumn("_held", F.lit(True)), keys, "left")
        held = F.col("_held")
    w = Window.partitionBy("event_uid", "code", "letter", F.col("reason").isNull()).orderBy("ord", "pick")
    again = F.col("reason").isNull() & (F.coalesce(held, F.lit(False)) | (F.row_number().over(w) > 1))
    status = F.when(again, "duplicate").otherwise(F.coalesce("reason", F.lit("matched")))
    return told.select("pick", status.alias("status"), F.when(status == "matched", F.col("event_uid")).alias("event_uid"))

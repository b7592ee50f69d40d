"""Station inventories: StationXML, separated text, code maps, station lines of travel-time programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STATION_XML = """
_code string, _startDate string,
Station array<struct<_code:string, _alternateCode:string, _startDate:string, _endDate:string, Latitude:double, Longitude:double, Elevation:double,
  Channel:array<struct<_code:string, _locationCode:string>>>>
"""


def _time(c):  # noqa: ANN001, ANN202
    return F.coalesce(*[F.try_to_timestamp(F.regexp_replace(c, "Z$", ""), F.lit(f)) for f in ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy:MM:dd'T'HH:mm:ss", "yyyy-MM-dd")])


def read_station_xml(spark: SparkSession, path: str) -> DataFrame:
    """network, station, code, alt_code, latitude, longitude, elevation, start_ts, end_ts, channels."""
    raw = spark.read.format("xml").option("rowTag", "Network").schema(_STATION_XML).load(path)
    s = raw.select(F.col("_code").alias("network"), F.explode("Station").alias("s"))
    return s.select(
        "network", F.col("s._code").alias("station"), F.concat_ws(".", "network", "s._code").alias("code"), F.col("s._alternateCode").alias("alt_code"),
        F.col("s.Latitude").alias("latitude"), F.col("s.Longitude").alias("longitude"), F.col("s.Elevation").alias("elevation"),
        _time(F.col("s._startDate")).alias("start_ts"), _time(F.col("s._endDate")).alias("end_ts"),
        F.transform("s.Channel", lambda c: c["_code"]).alias("channels"),
    )


def write_station_xml(sites: DataFrame, path: str) -> None:
    """Sites as StationXML, a row of elements for each network."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    station = F.struct(
        F.col("station").alias("_code"), F.col("alt_code").alias("_alternateCode"), day("start_ts").alias("_startDate"), day("end_ts").alias("_endDate"),
        F.col("latitude").alias("Latitude"), F.col("longitude").alias("Longitude"), F.col("elevation").alias("Elevation"),
    )
    nets = sites.groupBy(F.col("network").alias("_code")).agg(F.sort_array(F.collect_list(station)).alias("Station"))
    nets.write.format("xml").option("rootTag", "FDSNStationXML").option("rowTag", "Network").save(path)


def read_station_csv(spark: SparkSession, path: str) -> DataFrame:
    """network, station, latitude, longitude, elevation (0 if missing), start_ts, end_ts (null = open)."""
    c = spark.read.csv(path, header=True)
    return c.select(
        "network", "station", F.concat_ws(".", "network", "station").alias("code"), F.col("latitude").try_cast("double").alias("latitude"), F.col("longitude").try_cast("double").alias("longitude"),
        F.coalesce(F.col("elevation").try_cast("double"), F.lit(0.0)).alias("elevation"), _time(F.col("starttime")).alias("start_ts"), _time(F.col("endtime")).alias("end_ts"),
    )


def read_station_text(spark: SparkSession, path: str) -> DataFrame:
    """Channel rows separated by |: network, station, location, channel, latitude, longitude, elevation, rate, start_ts, end_ts."""
    names = "network station location channel latitude longitude elevation depth azimuth dip sensor scale freq units rate start end".split()
    c = spark.read.csv(path, sep="|", comment="#", schema=", ".join(f"{n} string" for n in names))
    c = c.where(F.trim("network") != "")
    number = lambda n: F.trim(n).try_cast("double").alias(n)
    return c.select("network", "station", F.coalesce("location", F.lit("")).alias("location"), "channel", number("latitude"), number("longitude"), number("elevation"), number("rate"), _time(F.trim("start")).alias("start_ts"), _time(F.trim("end")).alias("end_ts"))


def usable_channels(channels: DataFrame, box: tuple[float, float, float, float], start, end) -> DataFrame:  # noqa: ANN001
    """Channels inside (lat_min, lat_max, lon_min, lon_max), of broad-band or short-period sensors, at the default location, running over start to end."""
    lat0, lat1, lon0, lon1 = box
    return channels.where(
        F.col("latitude").between(lat0, lat1) & F.col("longitude").between(lon0, lon1) & F.substring("channel", 1, 2).isin("HH", "HN", "EH", "SH")
        & F.col("location").isin("00", "..", "") & (F.lit(start) >= F.col("start_ts")) & (F.col("end_ts").isNull() | (F.lit(end) <= F.col("end_ts")))
    )


def location_key(location, channel):  # noqa: ANN001, ANN201
    """The default locations 00, .. and '' all stand for the channel's band and instrument."""
    return F.when(location.isin("00", "..", ""), F.substring(channel, 1, 2)).otherwise(location)


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """(alt_code, code, network, sta, start_ts, end_ts, ord): blocks 'Alternate Code:' with one or more 'Station Code:'."""
    raw = spark.read.option("lineSep", "Alternate Code:").text(path)
    alt = F.trim(F.get(F.split("value", "\n"), F.lit(0)))
    stations = F.slice(F.split("value", "Station Code:"), 2, 1_000_000)
    rows = raw.select(F.monotonically_increasing_id().alias("block"), alt.alias("alt_code"), F.posexplode(stations).alias("k", "s"))
    field = lambda name: F.trim(F.regexp_extract("s", rf"{name}:[ \t]*([^\n]*)", 1))
    code = F.trim(F.get(F.split("s", "\n"), F.lit(0)))
    return rows.select(
        "alt_code", code.alias("code"), F.split_part(code, F.lit("."), F.lit(1)).alias("network"), F.split_part(code, F.lit("."), F.lit(-1)).alias("sta"),
        _time(field("Start Date")).alias("start_ts"), _time(field("End Date")).alias("end_ts"), (F.col("block") * 1_000 + F.col("k")).alias("ord"),
    )


def write_code_map(rows: DataFrame, path: str) -> None:
    """Blocks of a code map in the order of ord; open ends are written None."""
    day = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit("None"))
    part = F.concat(F.lit("Station Code: "), "code", F.lit("\nStart Date: "), day("start_ts"), F.lit("\nEnd Date: "), day("end_ts"))
    blocks = rows.groupBy("alt_code").agg(F.min("ord").alias("o"), F.sort_array(F.collect_list(F.struct("ord", part.alias("t")))).alias("p"))
    text = F.concat(F.lit("Alternate Code: "), "alt_code", F.lit("\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n"), F.lit("\n"))
    blocks.repartitionByRange("o").sortWithinPartitions("o").select(text.alias("value")).write.text(path)


def read_gtsrce(spark: SparkSession, path: str) -> DataFrame:
    """code, latitude, longitude, elevation (m) of GTSRCE lines; repeated lines once."""
    t = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value").startswith("GTSRCE")).select(t.alias("t")).distinct()
    n = lambda i: F.get("t", F.lit(i)).try_cast("double")
    return rows.select(F.get("t", F.lit(1)).alias("code"), n(3).alias("latitude"), n(4).alias("longitude"), (n(6) * 1000).alias("elevation"))


def read_last_stations(spark: SparkSession, path: str) -> DataFrame:
    """code, latitude, longitude, elevation of a program's list of used stations (code x y z lat lon depth)."""
    c = spark.read.csv(path, sep=" ", schema="code string, x double, y double, z double, latitude double, longitude double, depth double")
    return c.select("code", "latitude", "longitude", "depth")

"""Inputs and outputs of the external relocation program, and event lists of several layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.sources import obs

# The run file's velocity layers (top km, P km/s, S km/s, density), search and grid settings.
LAYERS = [(0.0, 5.5, 3.2, 2.72), (1, 5.6, 3.26, 2.7), (4, 6.1, 3.55, 2.8), (11, 6.4, 3.72, 2.8), (34, 8.0, 4.5, 3.32)]
GRID_KM = 0.05
GRID_DEPTHS = 800
VP_VS = 1.72
SETTINGS = [
    "GT_PLFD 1.0e-7 0",
    "LOCGAU 0.05 0.0",
    "LOCGAU2 0.01 0.01 2.0",
    "LOCPHASEID P P p G PN PG",
    "LOCPHASEID S S s G SN SG",
    "LOCQUAL2ERR 0.05 0.15 0.05 0.15 99999.9",
    "LOCPHSTAT 9999.0 -1 9999.0 1.0 1.0 9999.9 -9999.9 9999.9",
]


def read_solutions(spark: SparkSession, path: str) -> DataFrame:
    """Zone tables: zone (the parent folder's name), public_id, origin text, position, volume, ellipsoid, nphs, gap, rms."""
    c = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    zone = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    names = {"latitude": "lat", "longitude": "lon", "depth": "dep", "pdfVolume": "pdf_volume", "EllipsoidAz1": "az1", "EllipsoidDip1": "dip1", "EllipsoidLen1": "len1",
             "EllipsoidAz2": "az2", "EllipsoidDip2": "dip2", "EllipsoidLen2": "len2", "EllipsoidLen3": "len3", "Nphs": "nphs", "Gap": "gap", "RMS": "rms"}
    return c.select(zone.alias("zone"), F.col("publicId").alias("public_id"), F.col("`date-time`").alias("origin"), *[F.col(a).try_cast("double").alias(b) for a, b in names.items()])


def read_delays(spark: SparkSession, path: str) -> DataFrame:
    """sta, phase, n, correction, std of LOCDELAY lines."""
    t = F.split(F.trim("value"), r"\s+")
    g = lambda i: F.get(t, F.lit(i))
    return spark.read.text(path).where(F.trim("value").startswith("LOCDELAY")).select(g(1).alias("sta"), g(2).alias("phase"), g(3).try_cast("int").alias("n"), g(4).try_cast("double").alias("correction"), g(5).try_cast("double").alias("std"))


def usable_delays(delays: DataFrame, least: int = 100) -> DataFrame:
    return delays.where((F.col("n") >= least) & (F.col("std") >= 0))


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return rows.select(F.split(F.trim("value"), r"\s+").alias("t"))


def _full_year(y: Column, pivot: int) -> Column:
    """Two-digit years below the pivot are 20yy, others 19yy; longer years stay."""
    return F.when(y >= 100, y).when(y < pivot, y + 2000).otherwise(y + 1900)


def read_event_list(spark: SparkSession, path: str, layout: int, max_h: float = 3.0, max_v: float = 3.0) -> DataFrame:
    """year, month, day, hour, minute, lat, lon, dep, erh, erv, rms, gap, nphs of five layouts.

    1: relocated lists; 2 and 3: lists without errors (just below the limits are put in their
    place; 3 has no gap either); 4: bulletins; 5: lists with a # header. Where a layout lacks a
    value that later filters need, -1 stands for it.
    """
    schema = ["year", "month", "day", "hour", "minute"]
    if layout == 4:
        e = obs.read_events(spark, path)
        t = F.timestamp_micros("origin_us")
        minus = [F.lit(-1.0).alias(c) for c in ("erh", "erv", "rms", "gap")]
        parts = [f(t).alias(n) for n, f in zip(schema, (F.year, F.month, F.dayofmonth, F.hour, F.minute), strict=True)]
        return e.select(*parts, "lat", "lon", "dep", *minus, F.coalesce("phase_count", F.lit(-1.0)).alias("nphs"))
    n = lambda i: F.get("t", F.lit(i)).try_cast("double")
    fill = {1: {"erh": n(12), "erv": n(13), "rms": n(10), "gap": n(14), "nphs": n(11)}}
    near = {"erh": F.lit(max_h - 0.01), "erv": F.lit(max_v - 0.01), "rms": F.lit(0.0)}
    fill[2] = near | {"gap": n(13), "nphs": n(10)}
    fill[3] = near | {"gap": F.lit(None).cast("double"), "nphs": F.lit(None).cast("double")}
    fill[5] = {c: F.lit(-1.0) for c in ("erh", "erv", "rms", "gap", "nphs")}
    year = _full_year(n(0), 75) if layout == 1 else n(0)
    when = [year.cast("int").alias("year"), *[n(i).cast("int").alias(c) for i, c in enumerate(schema[1:], 1)]]
    return _tokens(spark, path).select(*when, n(6).alias("lat"), n(7).alias("lon"), n(8).alias("dep"), *[c.alias(k) for k, c in fill[layout].items()])


def read_relocated_text(spark: SparkSession, path: str, pivot: int = 76) -> DataFrame:
    """The 15 columns of relocated lists with origin_us; years below the pivot are 20yy."""
    names = "year month day hour minute second lat lon dep mag rms nphs erh erv gap".split()
    rows = _tokens(spark, path).where(F.size("t") == len(names)).select(*[F.get("t", F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])
    year = _full_year(F.col("year"), pivot).cast("int")
    day = F.try_make_timestamp(year, F.col("month").cast("int"), F.col("day").cast("int"), F.lit(0), F.lit(0), F.lit(0.0))
    us = F.unix_micros(day) + F.floor((F.col("hour") * 3600 + F.col("minute") * 60 + F.col("second")) * 1e6 + 0.5)
    return rows.withColumn("origin_us", us.cast("bigint"))


def read_hypo71(spark: SparkSession, path: str) -> DataFrame:
    """Fixed-width summaries: rows with unusable location fields are dropped, unusable quality fields are null."""
    num = lambda a, b: F.trim(F.substring("value", a + 1, b - a)).try_cast("double")
    date = F.lpad(F.trim(F.substring("value", 2, 6)), 6, "0")
    place = {"hhmm": num(7, 12), "second": num(12, 18), "lat_d": num(18, 21), "lat_m": num(21, 27), "lon_d": num(27, 31), "lon_m": num(31, 38), "dep": num(38, 45), "mag": num(47, 51)}
    quality = {"nphs": num(52, 55), "dm": num(55, 58), "gap": num(58, 62), "m": num(62, 64), "rms": num(64, 69), "erh": num(70, 74), "erv": num(75, 79)}
    rows = spark.read.text(path).select(date.alias("date"), *[c.alias(n) for n, c in (place | quality).items()])
    rows = rows.dropna(subset=list(place))
    whole = F.lit(True)
    for n in quality:
        whole = whole & F.col(n).isNotNull()
    part = lambda a: F.substring("date", a, 2).try_cast("int")
    return rows.select(
        part(1).alias("year"), part(3).alias("month"), part(5).alias("day"), F.floor(F.col("hhmm") / 100).cast("int").alias("hour"), (F.col("hhmm") % 100).cast("int").alias("minute"), "second",
        (F.col("lat_d") + F.col("lat_m") / 60).alias("lat"), (F.col("lon_d") + F.col("lon_m") / 60).alias("lon"), "dep", "mag", *[F.when(whole, F.col(n)).alias(n) for n in quality],
    )


def run_file(zones: DataFrame) -> DataFrame:
    """(zone_id, value): the text of each zone's run file. zones: zone_id, lat_sw, lon_sw, nx, ny, model, times, bulletin, out, stations."""
    layers = "\n".join(f"LAYER {top} {vp} 0.0 {vs} 0.0 {rho} 0.0" for top, vp, vs, rho in LAYERS)
    text = F.concat_ws(
        "\n",
        F.lit("CONTROL 1 54321"),
        F.format_string("TRANS LAMBERT WGS-84 %.2f %.2f 42 44 0.0", "lat_sw", "lon_sw"),
        F.format_string("VGOUT %s", "model"),
        F.lit("VGTYPE P"),
        F.format_string(f"VGGRID 2 %d %d 0.0 0.0 -3 {GRID_KM} {GRID_KM} {GRID_KM} SLOW_LEN", "nx", "ny"),
        F.lit(layers),
        F.format_string("GTFILES %s %s P", "model", "times"),
        F.lit("GTMODE GRID2D ANGLES_NO"),
        F.format_string("LOCFILES %s NLLOC_OBS %s %s", "bulletin", "times", "out"),
        F.lit("LOCHYPOUT SAVE_NLLOC_SUM"),
        F.format_string(f"LOCGRID %d %d {GRID_DEPTHS} 0.0 0.0 -3 {GRID_KM} {GRID_KM} {GRID_KM} PROB_DENSITY SAVE", "nx", "ny"),
        F.lit("LOCSEARCH OCT 50 50 5 0.001 50000 500 1 0"),
        F.lit(f"LOCMETH EDT_OT_WT 9999 4 -1 -1 {VP_VS} 6 -1.0 0"),
        F.format_string("INCLUDE %s", "stations"),
        F.lit("\n".join(SETTINGS)),
    )
    return zones.select("zone_id", text.alias("value"))


def read_run_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, lat_sw, lon_sw, nx, ny) of run files, from their TRANS and LOCGRID lines."""
    trans, grid = r"^TRANS\s+LAMBERT\s+WGS-84\s+([\d.\-]+)\s+([\d.\-]+)", r"^LOCGRID\s+(\d+)\s+(\d+)"
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value").where(F.col("value").rlike("^(TRANS|LOCGRID)"))
    pull = lambda p, i, kind: F.max(F.when(F.col("value").rlike(p), F.regexp_extract("value", p, i))).try_cast(kind)
    found = rows.groupBy("file").agg(pull(trans, 1, "double").alias("lat_sw"), pull(trans, 2, "double").alias("lon_sw"), pull(grid, 1, "int").alias("nx"), pull(grid, 2, "int").alias("ny"))
    return found.dropna()

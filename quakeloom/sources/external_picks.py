"""Pick files of temporary and citizen stations, each brought to (sta, phase, us, err_s, origin, file, ord).

Formats are registered by name; register_pick_format adds one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.sources.obs import number

Reader = Callable[[SparkSession, str], DataFrame]
_FORMATS: dict[str, Reader] = {}


def register_pick_format(name: str, reader: Reader) -> None:
    _FORMATS[name] = reader


def read_picks(spark: SparkSession, path: str, name: str) -> DataFrame:
    return _FORMATS[name](spark, path)


def _instant(text: Column) -> Column:
    """Microseconds of an ISO time with or without fraction; null for anything else."""
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?$"), text)
    return F.unix_micros(F.concat(iso, F.lit("Z")).try_cast("timestamp"))


def _error(phase: Column) -> Column:
    return F.when(phase == "P", 0.05).otherwise(0.15)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    t = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), t.alias("t"))


def _field(i: int) -> Column:
    return F.get("t", F.lit(i))


def _fixed(spark: SparkSession, path: str) -> DataFrame:
    """STA ? ? ? PHASE ? YYYYMMDD HHMM SS.SSSS GAU err ..."""
    day = F.unix_micros(F.try_to_timestamp(F.concat(_field(6), _field(7)), F.lit("yyyyMMddHHmm")))
    us = day + F.floor(number(_field(8)) * 1e6 + 0.5).cast("bigint")
    rows = _lines(spark, path).where(F.size("t") >= 11)
    return rows.select(_field(0).alias("sta"), _field(4).alias("phase"), us.alias("us"), number(_field(10)).alias("err_s"), F.lit("TEMP_OBS").alias("origin"), "file", "ord")


def _detector(spark: SparkSession, path: str) -> DataFrame:
    """NET.STA.LOC PHASE ISO8601 prob=p"""
    rows = _lines(spark, path).where((F.size("t") >= 3) & (F.size(F.split(_field(0), r"\.")) >= 2))
    sta = F.get(F.split(_field(0), r"\."), F.lit(1))
    return rows.select(sta.alias("sta"), _field(1).alias("phase"), _instant(_field(2)).alias("us"), _error(_field(1)).alias("err_s"), F.lit("TEMP_RSB").alias("origin"), "file", "ord")


def _detector_csv(spark: SparkSession, path: str) -> DataFrame:
    """file_name, begin_time, station_id, phase_index, phase_time, phase_score, phase_ampl, phase_type; all CSV files below a folder."""
    schema = "file_name string, begin_time string, station_id string, phase_index string, phase_time string, phase_score string, phase_ampl string, phase_type string"
    c = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(path, header=True, schema=schema)
    c = c.where(F.size(F.split("station_id", r"\.")) >= 2)
    phase, sta = F.trim("phase_type"), F.get(F.split("station_id", r"\."), F.lit(1))
    return c.select(sta.alias("sta"), phase.alias("phase"), _instant(F.trim("phase_time")).alias("us"), _error(phase).alias("err_s"), F.lit("TEMP_OMP").alias("origin"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"))


register_pick_format("TEMP_OBS", _fixed)
register_pick_format("TEMP_RSB", _detector)
register_pick_format("TEMP_OMP", _detector_csv)


def without(picks: DataFrame, stations: list[str], folders: list[str]) -> DataFrame:
    """Leaves out stations (files PICKS_x.csv) and year folders by name."""
    station = F.regexp_extract("file", r"PICKS_([^/.]+)\.csv$", 1)
    year = F.regexp_extract("file", r"/([^/]*?(\d{4})[^/]*)/[^/]+$", 2)
    return picks.where(~station.isin(*stations) & ~year.isin(*folders))


def joined_text(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of all .txt files of a folder with file and place, to be ordered by both; a missing folder has none."""
    from pyspark.errors import AnalysisException

    try:
        raw = spark.read.option("pathGlobFilter", "*.txt").text(folder)
    except AnalysisException:
        return spark.createDataFrame([], "file string, ord bigint, value string")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord"), "value")


def read_travel_times(spark: SparkSession, path: str) -> DataFrame:
    """distance, tp_low, tp_high, ts_low, ts_high with k, the row's number."""
    c = spark.read.csv(path, header=True, schema="distance double, tp_low double, tp_high double, ts_low double, ts_high double")
    return c.withColumn("k", F.round(F.col("distance") / 0.5).cast("int"))


def envelope(arrivals: DataFrame) -> DataFrame:
    """Envelope over models and depths: model (min = slow, plu = fast), depth, distance, tp, ts.

    At the least depth both models bound both sides; at the others the slow model bounds
    below and the fast model above. A missing time makes the bound null.
    """
    a = arrivals.where(F.col("model").isin("min", "plu"))
    least = a.agg(F.min("depth").alias("d0"))
    a = a.join(F.broadcast(least)).withColumn("shallow", F.col("depth") == F.col("d0"))  # one row
    low, high = F.col("shallow") | (F.col("model") == "min"), F.col("shallow") | (F.col("model") == "plu")

    def bound(f, c: str, side: Column) -> Column:  # noqa: ANN001
        return F.when(F.count(F.when(side & F.col(c).isNull(), 1)) == 0, f(F.when(side, F.col(c))))

    return a.groupBy("distance").agg(
        bound(F.min, "tp", low).alias("tp_low"), bound(F.max, "tp", high).alias("tp_high"), bound(F.min, "ts", low).alias("ts_low"), bound(F.max, "ts", high).alias("ts_high")
    )

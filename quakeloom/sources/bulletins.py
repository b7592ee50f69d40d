"""Decoders of the source bulletins: GSE2 text in two layouts, OMP listings, LDG tables, QuakeML.

Every reader gives (events, picks) as DataFrames. Events have file, seq, origin_us, lat, lon,
dep, mag, mag_type, mag_author, phase_count, az_gap, rms (and erh, erv where given); picks file, seq, pick_seq, code, ins,
phase, real_phase, us, err_s, channel. Unusable numbers are null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions.seismic import pick_error
from quakeloom.session import staged


@dataclass(frozen=True)
class Gse2Layout:
    """Lines of a block, counted from the one with the marker, and the agency of the picks."""

    header: int
    magnitude: int
    picks: int
    least_magnitude: float | None = None


# Where the two agencies put header, magnitude and picks.
ICGC = Gse2Layout(3, 6, 11, 0.0)
IGN = Gse2Layout(4, 11, 15)
OMP_CENTURY = 78  # two-digit years below are 20yy


def _at(line: Column, first: int, end: int) -> Column:
    return F.trim(F.substring(line, first + 1, end - first))


def _num(text: Column) -> Column:
    v = text.try_cast("double")
    return F.when(~F.isnan(v), v)


def _micros(seconds: Column) -> Column:
    return F.floor(seconds * 1e6 + 0.5).cast("bigint")


def _blocks(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """One row per text between markers, split by the reader itself, so that files need not fit a task.

    Kept as a table, so that the events and picks read from it have one key.
    """
    raw = spark.read.option("lineSep", marker).text(path)
    lines = F.split(F.regexp_replace("value", "\r", ""), "\n")
    return staged(raw.select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq"), lines.alias("lines")), "blocks")


def _pick_lines(blocks: DataFrame, first: int) -> DataFrame:
    """Lines from the given one to the first empty one."""
    rest = F.slice("lines", F.lit(first + 1), F.greatest(F.size("lines"), F.lit(0)))
    end = F.array_position(F.transform(rest, lambda x: F.trim(x) == ""), F.lit(True))
    own = F.when(end > 0, F.slice(rest, F.lit(1), (end - 1).cast("int"))).otherwise(rest)
    return blocks.select("*", F.posexplode(own).alias("k", "line")).drop("lines")


def read_gse2(spark: SparkSession, path: str, layout: Gse2Layout) -> tuple[DataFrame, DataFrame]:
    """Manual P and S picks of events with a magnitude. A pick at hour 00 of an event at hour 23 is of the next day."""
    h, m = F.get("lines", F.lit(layout.header)), F.get("lines", F.lit(layout.magnitude))
    day = F.try_to_timestamp(_at(h, 0, 10), F.lit("yyyy/MM/dd"))
    clock = _num(_at(h, 11, 13)) * 3600 + _num(_at(h, 14, 16)) * 60 + _num(_at(h, 17, 22))
    b = _blocks(spark, path, "DATA_TYPE").select(
        "file", "seq", "lines", day.alias("day"), (F.unix_micros(day) + _micros(clock)).alias("origin_us"), _at(h, 11, 13).alias("hour"),
        _num(_at(h, 36, 44)).alias("lat"), _num(_at(h, 45, 54)).alias("lon"), _num(_at(h, 71, 76)).alias("dep"),
        _num(_at(m, 7, 10)).alias("mag"), _at(m, 0, 6).alias("mag_type"), _at(m, 20, 29).alias("mag_author"),
        _num(_at(h, 89, 93)).alias("phase_count"), _num(_at(h, 92, 97)).alias("az_gap"), _num(_at(h, 30, 35)).alias("rms"),
    )
    b = b.where(F.col("mag").isNotNull() & F.col("origin_us").isNotNull())
    if layout.least_magnitude is not None:
        b = b.where(F.col("mag") >= layout.least_magnitude)
    line = F.col("line")
    phase = _at(line, 19, 27)
    next_day = F.when((F.col("hour") == "23") & (_at(line, 28, 30) == "00"), 1).otherwise(0)
    sec = _num(F.concat_ws(".", _at(line, 34, 36), _at(line, 37, 41)))
    us = F.unix_micros("day") + next_day * 86_400_000_000 + _micros(_num(_at(line, 28, 30)) * 3600 + _num(_at(line, 31, 33)) * 60 + sec)
    picks = _pick_lines(b, layout.picks).where(F.lower(phase).rlike("^[ps]") & (_at(line, 99, 102) == "m__"))
    picks = picks.select(
        "file", "seq", (F.col("k") + 1).alias("pick_seq"), F.concat_ws(".", _at(line, 114, 116), _at(line, 0, 7)).alias("code"), F.lit("?").alias("ins"),
        F.substring(phase, 1, 1).alias("phase"), phase.alias("real_phase"), us.alias("us"), pick_error(phase).alias("err_s"),
        F.when(_at(line, 119, 123) != "", _at(line, 119, 123)).alias("channel"),
    )
    return b.drop("lines", "day", "hour"), picks


def read_omp(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Listings with degrees and minutes; each line gives up to a P and an S pick.

    Lines of the worst qualities and without P second are left out, doubtful stations get
    instrument *, middling qualities the doubled error. A blank quality digit counts as good.
    """
    b = _blocks(spark, path, " Localisation")
    e, west = F.get("lines", F.lit(4)), F.when(F.substring(F.get("lines", F.lit(2)), 36, 1) == "W", -1.0).otherwise(1.0)
    yy = _at(e, 0, 3).try_cast("int")
    year = F.when(yy < OMP_CENTURY, yy + 2000).otherwise(yy + 1900)
    hour, minute, second = _at(e, 8, 10).try_cast("int"), _at(e, 10, 12).try_cast("int"), _num(_at(e, 13, 18))
    day = F.try_make_timestamp(year, _at(e, 3, 5).try_cast("int"), _at(e, 5, 7).try_cast("int"), F.lit(0), F.lit(0), F.lit(0.0))
    over = F.when(second >= 60, 1).otherwise(0)
    clock = F.least(hour, F.lit(23)) * 3600 + (minute + over) * 60 + second - over * 60
    b = b.select(
        "file", "seq", "lines", day.alias("day"), F.when((minute + over) < 60, F.unix_micros(day) + _micros(clock)).alias("origin_us"),
        (hour >= 24).alias("late"), (minute + over).alias("minute"),
        (_at(e, 19, 21).try_cast("int") + _num(_at(e, 22, 27)) / 60).alias("lat"), (west * (_at(e, 29, 31).try_cast("int") + _num(_at(e, 32, 37)) / 60)).alias("lon"),
        _num(_at(e, 39, 44)).alias("dep"), _num(_at(e, 51, 54)).alias("mag"), F.lit("ML").alias("mag_type"), F.lit("OMP").alias("mag_author"),
        F.lit(None).cast("double").alias("phase_count"), F.lit(None).cast("double").alias("az_gap"), _num(_at(e, 45, 50)).alias("rms"),
    )
    b = b.where((F.col("mag") >= -5) & (F.col("mag") != 9.9) & F.col("origin_us").isNotNull())
    line = F.col("line")
    qp, qs = F.substring(line, 24, 1), F.substring(line, 103, 1)
    station = _at(line, 1, 5)
    doubtful = (qp == "9") | (station == "LARF")
    doubled = ~doubtful & (F.coalesce(qp.try_cast("int") >= 2, F.lit(False)) | F.coalesce(qs.try_cast("int") >= 3, F.lit(False)))
    p = _pick_lines(b, 7).where((qp != "4") & (qs != "0") & ~_at(line, 30, 35).rlike(r"\*|^$"))
    hh = F.when(F.col("late"), 23).otherwise(_at(line, 25, 27).try_cast("int"))

    def arrival(sec: Column) -> Column:
        mm = F.when(sec < 0, F.col("minute") - 1).otherwise(_at(line, 27, 29).try_cast("int"))
        return F.unix_micros("day") + _micros(hh * 3600 + mm * 60 + F.when(sec < 0, sec + 60).otherwise(sec))

    readings = F.array(
        F.struct(F.lit("P").alias("phase"), arrival(_num(_at(line, 30, 35))).alias("us")),
        F.struct(F.lit("S").alias("phase"), F.when(~_at(line, 105, 110).rlike(r"\*|^$"), arrival(_num(_at(line, 105, 110)))).alias("us")),
    )
    p = p.select(
        "file", "seq", (F.col("k") + 1).alias("row"), F.concat(F.lit("."), station).alias("code"), F.when(doubtful, "*").otherwise("?").alias("ins"),
        F.when(doubled, 0.10).otherwise(0.05).alias("err_s"), F.explode(readings).alias("r"),
    )
    place = (F.col("row") * 2 - F.when(F.col("r.phase") == "P", 1).otherwise(0)).cast("int")
    picks = p.where(F.col("r.us").isNotNull()).select(
        "file", "seq", place.alias("pick_seq"), "code", "ins", "r.phase", F.col("r.phase").alias("real_phase"), "r.us", "err_s", F.lit(None).cast("string").alias("channel")
    )
    return b.drop("lines", "day", "late", "minute"), picks


def read_ldg(spark: SparkSession, catalog: str, arrivals: str) -> tuple[DataFrame, DataFrame]:
    """Two tables with ; between columns: ML else MD (-999 = missing), origins in whole seconds; events without picks stay."""
    c = spark.read.csv(catalog, sep=";", header=True)
    value = lambda n: F.when(_num(F.col(n)) != -999, _num(F.col(n)))
    ml = value("ML").isNotNull()
    when = F.unix_micros(F.try_to_timestamp(F.substring(F.trim("datetime"), 1, 19), F.lit("dd/MM/yyyy HH:mm:ss")))
    file = F.col("_metadata.file_path")
    events = c.select(
        file.alias("file"), F.col("orid").try_cast("bigint").alias("seq"), when.alias("origin_us"), _num(F.col("lat")).alias("lat"), _num(F.col("lon")).alias("lon"),
        _num(F.col("depth")).alias("dep"), F.coalesce(value("ML"), value("MD")).alias("mag"), F.when(ml, "ML").otherwise("MD").alias("mag_type"), F.lit("LDG").alias("mag_author"),
        F.when(ml, _num(F.col("nbmagML"))).otherwise(_num(F.col("nbmagMD"))).alias("phase_count"), _num(F.col("gap1")).alias("az_gap"), _num(F.col("rms")).alias("rms"),
    ).where(F.col("mag").isNotNull())
    a = spark.read.csv(arrivals, sep=";", header=True).withColumn("k", F.monotonically_increasing_id())
    at = F.unix_micros(F.try_to_timestamp(F.substring(F.trim("arrtime"), 1, 16), F.lit("dd/MM/yyyy HH:mm"))) + _micros(_num(F.substring(F.trim("arrtime"), 18, 5)))
    phase = F.trim("phase")
    picks = a.where(F.lower(phase).rlike("^[ps]")).select(
        F.col("orid").try_cast("bigint").alias("seq"), F.col("k").alias("pick_seq"), F.concat(F.lit("."), F.trim("sta")).alias("code"), F.lit("?").alias("ins"),
        F.substring(phase, 1, 1).alias("phase"), phase.alias("real_phase"), at.alias("us"), pick_error(phase).alias("err_s"), F.lit(None).cast("string").alias("channel"),
    )
    return events, picks.join(events.select("file", "seq"), "seq").select("file", *picks.columns)


_QUAKEML = """
_publicID string, preferredMagnitudeID string,
origin array<struct<time:struct<value:string>, latitude:struct<value:double>, longitude:struct<value:double>, depth:struct<value:double>,
  quality:struct<associatedPhaseCount:double, azimuthalGap:double, standardError:double>>>,
magnitude array<struct<_publicID:string, type:string, evaluationStatus:string, mag:struct<value:double, uncertainty:double>, creationInfo:struct<author:string, agencyID:string>>>,
pick array<struct<time:struct<value:string>, waveformID:struct<_networkCode:string, _stationCode:string, _channelCode:string>, phaseHint:string, evaluationMode:string>>
"""


def best_magnitude(magnitudes: Column, preferred: Column, kind: str) -> Column:
    """The magnitude of an event by rank: the preferred one if of the kind and not automatic; of the others of
    the kind that are not automatic the one of least uncertainty (null if two lack it); the last confirmed one."""
    of_kind = F.filter(magnitudes, lambda m: m["type"] == kind)
    manual = lambda m: ~F.coalesce(m["creationInfo"]["author"], F.lit("")).contains("auto")
    first = F.filter(of_kind, lambda m: (m["_publicID"] == preferred) & m["creationInfo"]["author"].isNotNull() & manual(m))
    by_hand = F.filter(of_kind, manual)
    vague = F.size(F.filter(by_hand, lambda m: m["mag"]["uncertainty"].isNull()))
    least = F.array_min(F.transform(by_hand, lambda m: m["mag"]["uncertainty"]))
    sure = F.filter(by_hand, lambda m: m["mag"]["uncertainty"].eqNullSafe(least))
    told = F.filter(of_kind, lambda m: m["evaluationStatus"] == "confirmed")
    return (
        F.when(F.size(first) > 0, F.get(first, F.lit(0)))
        .when((F.size(by_hand) > 1) & (vague > 0), None)
        .when(F.size(by_hand) > 0, F.get(sure, F.lit(0)))
        .when(F.size(told) > 0, F.element_at(told, -1))
    )


def read_quakeml(spark: SparkSession, path: str, mag_type: str = "MLv") -> tuple[DataFrame, DataFrame]:
    """Events with a magnitude of the wanted type, their first origin, and manual P and S picks cut to milliseconds."""
    raw = spark.read.format("xml").option("rowTag", "event").schema(_QUAKEML).load(path)
    raw = staged(raw.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq")), "blocks")
    o, m = F.get("origin", F.lit(0)), best_magnitude(F.col("magnitude"), F.col("preferredMagnitudeID"), mag_type)
    us = lambda t: F.unix_micros(F.to_timestamp(F.regexp_replace(t, "Z$", "")))
    e = raw.withColumn("m", m).where(F.col("m").isNotNull())
    events = e.select(
        "file", "seq", us(o["time"]["value"]).alias("origin_us"), o["latitude"]["value"].alias("lat"), o["longitude"]["value"].alias("lon"),
        (o["depth"]["value"] / 1000).alias("dep"), F.col("m.mag.value").alias("mag"), F.col("m.type").alias("mag_type"), F.col("m.creationInfo.agencyID").alias("mag_author"),
        o["quality"]["associatedPhaseCount"].alias("phase_count"), o["quality"]["azimuthalGap"].alias("az_gap"), o["quality"]["standardError"].alias("rms"),
    )
    p = e.select("file", "seq", F.posexplode("pick").alias("k", "p"))
    p = p.where(F.lower("p.phaseHint").rlike("^[ps]") & (F.col("p.evaluationMode") == "manual"))
    at = F.floor(us(F.col("p.time.value")) / 1000) * 1000
    picks = p.select(
        "file", "seq", (F.col("k") + 1).alias("pick_seq"), F.concat_ws(".", "p.waveformID._networkCode", "p.waveformID._stationCode").alias("code"), F.lit("?").alias("ins"),
        F.substring("p.phaseHint", 1, 1).alias("phase"), F.col("p.phaseHint").alias("real_phase"), at.alias("us"), pick_error(F.col("p.phaseHint")).alias("err_s"),
        F.col("p.waveformID._channelCode").alias("channel"),
    )
    return events, picks

"""Problem 2: timestamps in mixed formats and time zones, brought to one UTC instant.

Distinct (text, time zone, date order) triples go into a dictionary that is parsed
once, with JVM expressions, and kept in a table; texts already in the table are not
parsed again. The parsed instants are joined back to the rows, where a clock reading
that occurs twice is settled by the time the row was received.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.session import new_stage_path, staged, table

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z$"

# Month names (English, French, Spanish, Catalan), accents folded.
MONTHS = [
    "jan january janvier janv enero ene gener gen",
    "feb february fevrier fev fevr febrero febrer",
    "mar march mars marzo marc",
    "apr april avril avr abril abr",
    "may mai mayo maig",
    "jun june juin junio juny",
    "jul july juillet juil julio juliol",
    "aug august aout agosto ago agost",
    "sep sept september septembre septiembre setembre set",
    "oct october octobre octubre",
    "nov november novembre noviembre",
    "dec december decembre diciembre dic desembre des",
]
# Minutes east of UTC of the zone names written behind a time.
ZONE_MINUTES = {"Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "TU": 0, "TUC": 0, "WET": 0, "WEST": 60, "CET": 60, "CEST": 120}
DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000
MINUTE_US = 60_000_000

_TIME = r"(\d{1,2}):(\d{2}):(\d{2})(?:[.,](\d+))?"
# pattern, template of year|month|day|day of year|hour|minute|second|fraction; {…} by date order.
_FORMS = [
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})[T ]+" + _TIME + "$", "$1|$2|$3||$4|$5|$6|$7"),
    (r"^(\d{4})-(\d{3})[T ]" + _TIME + "$", "$1|||$2|$3|$4|$5|$6"),
    (r"^(\d{4})\.(\d{3})\.(\d{2})\.(\d{2})\.(\d{2})(?:\.(\d+))?$", "$1|||$2|$3|$4|$5|$6"),
    (r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})(?:[.,](\d+))?$", "$1|$2|$3||$4|$5|$6|$7"),
    (r"^(\d{4})(\d{2})(\d{2}) (\d{2})(\d{2}) (\d{1,2})(?:[.,](\d+))?$", "$1|$2|$3||$4|$5|$6|$7"),
    (r"^(\d{4}) (\d{1,2}) (\d{1,2}) (\d{1,2}) (\d{1,2}) (\d{1,2})(?:[.,](\d+))?$", "$1|$2|$3||$4|$5|$6|$7"),
]
_BY_ORDER = [
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}),?[T ]+" + _TIME + "$", {"mdy": "$3|$1|$2||$4|$5|$6|$7", "": "$3|$2|$1||$4|$5|$6|$7"}),
    (
        r"^(\d{2})[-/.](\d{2})[-/.](\d{2}),?[T ]+" + _TIME + "$",
        {"mdy": "20$3|$1|$2||$4|$5|$6|$7", "ymd": "20$1|$2|$3||$4|$5|$6|$7", "": "20$3|$2|$1||$4|$5|$6|$7"},
    ),
]
_NAMED = [
    (r"^(\d{1,2})(?:er)?[- ](?:de )?([a-z]+)\.?[- ](?:de )?(\d{4}),?[t ]+(\d{1,2})[:h](\d{2})[:m](\d{2})(?:[.,](\d+))?s?$", (3, 2, 1)),
    (r"^([a-z]+)\.? (\d{1,2}),? (\d{4}),?[t ]+(\d{1,2})[:h](\d{2})[:m](\d{2})(?:[.,](\d+))?s?$", (3, 1, 2)),
]
_EPOCH = r"^\d{10}(?:\.\d+)?$|^\d{13}$|^\d{16}$"
_ACCENTS = ("àáâäèéêëìíîïòóôöùúûüçñ", "aaaaeeeeiiiioooouuuucn")


def _whole(c: Column) -> Column:
    return c.try_cast("bigint")


def _micros(fraction: Column) -> Column:
    """Digits behind the decimal point as microseconds, further digits cut."""
    return _whole(F.rpad(F.substring(F.coalesce(fraction, F.lit("")), 1, 6), 6, "0"))


def _epoch_us(s: Column) -> Column:
    whole = F.regexp_extract(s, r"^(\d+)", 1)
    fraction = F.regexp_extract(s, r"\.(\d+)$", 1)
    n = F.length(whole)
    return F.when(
        s.rlike(_EPOCH),
        F.when(n == 10, _whole(whole) * 1_000_000 + _micros(fraction))
        .when(n == 13, _whole(whole) * 1000)
        .otherwise(_whole(whole)),
    )


def parsed(raw: DataFrame) -> DataFrame:
    """raw: event_dt, time_zone, date_order -> the same with first_us and second_us.

    first_us is the instant in microseconds since 1970 (null if the text denotes none);
    second_us the later one of a local clock reading that occurs twice.
    """
    s = F.regexp_replace(F.trim(F.regexp_replace("event_dt", r"[\s  ]+", " ")), r"[.,;]$", "")
    zone = r"(?i)\s*(Z|UTC|GMT|UT|TUC|TU|CEST|CET|WEST|WET|[+-]\d{2}(?::?\d{2})?)$"
    timed = F.col("_s").rlike(r"\d{1,2}[:h]\d{2}|T\d{6}|^\d{8} \d{4} \d")
    df = raw.withColumn("_s", s)
    df = df.withColumn("_zone", F.when(timed, F.upper(F.regexp_extract("_s", zone, 1))).otherwise(""))
    df = df.withColumn("_b", F.when(F.col("_zone") != "", F.regexp_replace("_s", zone, "")).otherwise(F.col("_s")))
    half = F.upper(F.regexp_extract("_b", r"(?i)\s*([ap])\.?m\.?$", 1))
    df = df.withColumn("_half", half).withColumn("_b", F.regexp_replace("_b", r"(?i)\s*[ap]\.?m\.?$", ""))
    b = F.col("_b")
    low = F.translate(F.lower(b), *_ACCENTS)
    names = F.create_map(*[F.lit(x) for m, row in enumerate(MONTHS, 1) for name in row.split() for x in (name, str(m))])
    order = F.coalesce("date_order", F.lit(""))
    parts = F.lit(None).cast("string")
    for pattern, template in reversed(_FORMS):
        parts = F.when(b.rlike(pattern), F.regexp_replace(b, pattern, template)).otherwise(parts)
    for pattern, templates in reversed(_BY_ORDER):
        text = F.regexp_replace(b, F.lit(pattern), F.lit(templates[""]))
        for o, template in templates.items():
            if o:
                text = F.when(order == o, F.regexp_replace(b, pattern, template)).otherwise(text)
        parts = F.when(b.rlike(pattern), text).otherwise(parts)
    for pattern, (y, m, d) in reversed(_NAMED):
        month = F.try_element_at(names, F.regexp_extract(low, pattern, m))
        day = F.regexp_extract(low, pattern, d)
        rest = [F.regexp_extract(low, pattern, i) for i in (4, 5, 6, 7)]
        text = F.concat_ws("|", F.regexp_extract(low, pattern, y), month, day, F.lit(""), *rest)
        parts = F.when(low.rlike(pattern) & month.isNotNull(), text).otherwise(parts)
    df = df.withColumn("_p", F.split(parts, r"\|"))
    year, month, day, doy, hour, minute, second = [_whole(F.get("_p", F.lit(i))) for i in range(7)]
    hour = F.when((F.col("_half") == "P") & (hour < 12), hour + 12).when((F.col("_half") == "A") & (hour == 12), 0).otherwise(hour)
    date = F.when(
        F.get("_p", F.lit(3)) != "",
        F.when(
            doy.between(1, F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))),
            F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int")),
        ),
    ).otherwise(F.to_date(F.try_to_timestamp(F.format_string("%04d-%02d-%02d", year, month, day), F.lit("yyyy-MM-dd"))))
    date = F.when(year.between(1, 9999), date)
    local = F.when(
        hour.between(0, 24) & minute.between(0, 59) & second.between(0, 60),
        F.unix_date(date).cast("bigint") * DAY_US
        + hour * HOUR_US
        + minute * MINUTE_US
        + second * 1_000_000
        + _micros(F.get("_p", F.lit(7))),
    )
    offsets = F.create_map(*[F.lit(x) for name, minutes in ZONE_MINUTES.items() for x in (name, minutes)])
    z = F.col("_zone")
    sign = F.when(z.startswith("-"), -1).otherwise(1)
    digits = F.rpad(F.regexp_replace(z, "[^0-9]", ""), 4, "0")
    minutes = F.when(
        z.rlike(r"^[+-]"), sign * (_whole(F.substring(digits, 1, 2)) * 60 + _whole(F.substring(digits, 3, 2)))
    ).otherwise(F.try_element_at(offsets, z))
    df = df.withColumn("_local", local).withColumn("_minutes", minutes)
    tz = F.col("time_zone")
    here = F.col("_local")
    earlier = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(here), tz))
    first = F.coalesce(
        _epoch_us(b),
        F.when(F.col("_minutes").isNotNull(), here - F.col("_minutes") * MINUTE_US),
        F.when((z == "") & tz.isNotNull(), earlier),
    )
    df = df.withColumn("first_us", first)
    own = (z == "") & tz.isNotNull() & here.isNotNull()
    second = F.lit(None).cast("bigint")
    for step in (30 * MINUTE_US, HOUR_US):
        later = F.col("first_us") + step
        reads = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(later), tz))
        second = F.when(own & (reads == here), later).otherwise(second)
    return df.select("event_dt", "time_zone", "date_order", "first_us", second.alias("second_us"))


def _kept(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def dictionary(raw: DataFrame, path: str) -> DataFrame:
    """Parses the distinct texts that the table at path does not hold, appends them and reads all."""
    spark = raw.sparkSession
    keys = ["event_dt", "time_zone", "date_order"]
    fresh = raw.where(F.col("event_dt").rlike("[0-9]")).select(*keys).distinct()
    kept = _kept(spark, path)
    if kept is not None:
        same = F.lit(True)
        old = kept.select(*[F.col(k).alias(f"_{k}") for k in keys])
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        fresh = fresh.join(old, same, "left_anti")
    parsed(fresh).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def to_instants(rows: DataFrame, sources: DataFrame, path: str | None = None) -> DataFrame:
    """rows (event_dt, source, received_ts and others) with utc_us, the instant in microseconds since 1970.

    sources: source, time_zone, date_order; a source missing there has neither, so that its
    texts without zone denote nothing. A local time that occurs twice is the later one not
    after received_ts, the earlier if received_ts is null; one that never occurs is read with
    the offset before the change. Null, empty and unusable texts and impossible dates give
    null. Rows stay as they are, repeated ones too; a column utc_us of theirs is replaced. path: where the dictionary is kept
    between runs; without it a new table in the shared folder. The rows of one delivery must be written before
    the next one is added to the dictionary, if one query is to have both.
    """
    spark = rows.sparkSession
    path = path or new_stage_path(spark, "instants")
    zones = sources.select(
        F.col("source").alias("_source"), F.col("time_zone").alias("_tz"), F.col("date_order").alias("_order")
    ).dropDuplicates(["_source"])
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("_row")
    keyed = rows.select(whole, "event_dt", "source", "received_ts").join(zones, F.col("source") == F.col("_source"), "left")
    known = dictionary(
        keyed.select("event_dt", F.col("_tz").alias("time_zone"), F.col("_order").alias("date_order")), path
    ).where(F.col("first_us").isNotNull())
    known = known.select(
        F.col("event_dt").alias("_dt"), F.col("time_zone").alias("_z"), F.col("date_order").alias("_o"), "first_us", "second_us"
    )
    on = (F.col("event_dt") == F.col("_dt")) & F.col("_tz").eqNullSafe(F.col("_z")) & F.col("_order").eqNullSafe(F.col("_o"))
    received = F.unix_micros("received_ts")
    utc = F.when(F.col("second_us") <= received, F.col("second_us")).otherwise(F.col("first_us"))
    old = [F.col(f"_row.`{c}`").alias(c) for c in rows.columns if c != "utc_us"]
    # texts without a digit are in no dictionary, and must not meet in one task
    some = F.coalesce(F.col("event_dt").rlike("[0-9]"), F.lit(False))
    read = keyed.where(some).join(known, on, "left").select(*old, utc.alias("utc_us"))
    return read.unionByName(keyed.where(~some).select(*old, F.lit(None).cast("bigint").alias("utc_us")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "event_raw").select("raw_id", "source", "event_dt", "received_ts")
    done = to_instants(rows, table(spark, sf_dir, "source_info"))
    return done.where(F.col("utc_us").isNotNull() & ~F.col("event_dt").rlike(CANONICAL)).select("raw_id", "utc_us").distinct()


def p2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over two deliveries, the second one parsing only texts that the first did not bring: all usable rows of both."""
    rows = table(spark, sf_dir, "event_raw").select("raw_id", "source", "event_dt", "received_ts")
    sources = table(spark, sf_dir, "source_info")
    path = new_stage_path(spark, "instants")
    second = F.coalesce(F.col("raw_id") % 2 == 1, F.lit(True))
    early = staged(to_instants(rows.where(~second), sources, path), "early")
    late = to_instants(rows.where(second), sources, path)
    return early.unionByName(late).where(F.col("utc_us").isNotNull()).select("raw_id", "utc_us").distinct()

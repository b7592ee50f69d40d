"""Bulletins of event blocks: a header line of 17 tokens, a public id, and pick lines of fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Pick columns as (name, first character, end), counted from 0.
PICK_COLUMNS = [
    ("code", 0, 9), ("ins", 10, 14), ("comp", 15, 19), ("onset", 20, 21), ("phase", 22, 28), ("dir", 29, 30), ("date", 31, 39),
    ("hhmm", 40, 44), ("sec", 45, 51), ("err", 52, 55), ("errmag", 56, 65), ("coda", 66, 75), ("amp", 76, 85), ("period", 86, 95),
    ("real_phase", 98, 104), ("channel", 105, 109), ("origin", 110, 119), ("pgv", 120, 124),
]
HEADER = "year month day hour minute sec lat lon dep mag mag_type mag_author phase_count erh erv az_gap rms".split()
MISSING = ["None", "Nan", "NaN", "nan", "?", "***", "-999", "-999.0"]


def number(text: Column) -> Column:
    """A token as double; null for a missing-value mark or anything that is no number."""
    v = F.when(~F.trim(text).isin(*MISSING), F.trim(text).try_cast("double"))
    return F.when(~F.isnan(v), v)


def _us(date: Column, hhmm: Column, sec: Column) -> Column:
    whole = F.try_to_timestamp(F.concat(date, hhmm), F.lit("yyyyMMddHHmm"))
    return F.unix_micros(whole) + F.floor(number(sec) * 1e6 + 0.5).cast("bigint")


def pick_columns(line: Column) -> dict[str, Column]:
    """The columns of a pick line: texts trimmed, us, err_s, coda, amp and period as numbers; null where unusable."""
    text = {n: F.trim(F.substring(line, a + 1, b - a)) for n, a, b in PICK_COLUMNS}
    out = {n: text[n] for n in ("code", "ins", "comp", "onset", "phase", "dir", "real_phase", "channel", "origin", "pgv")}
    out["us"] = _us(text["date"], text["hhmm"], text["sec"])
    return out | {"err_s": number(text["errmag"]), "coda": number(text["coda"]), "amp": number(text["amp"]), "period": number(text["period"])}


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a bulletin that are not blank and no comment (###): file, seq, at, line.

    An event begins at each line that begins with "# "; seq is the number of such lines in the
    file up to this one, counted within each split of the file and shifted by the splits
    before, so that events and picks that are read apart have the same key. at keeps the order within an event.
    Lines before the first event are left out. Any line end will do.
    """
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"),
        F.rtrim(F.regexp_replace("value", "\r", "")).alias("line"),
    )
    raw = raw.where(F.col("line").rlike(r"\S") & ~F.col("line").startswith("###"))
    head = F.col("line").startswith("# ").cast("long")
    counts = raw.groupBy("file", "split").agg(F.sum(head).alias("n"))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    shifts = counts.select("file", "split", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    upto = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seq = F.sum(head).over(upto) + F.col("shift")
    numbered = raw.join(shifts, ["file", "split"]).withColumn("seq", seq).where("seq > 0")
    return numbered.select("file", "seq", F.struct("split", "at").alias("at"), "line")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The headers of a bulletin: file, seq (order in the file, from 1), origin_us and the typed header columns, public_id.

    A header of other than 17 tokens gives nulls in all of them, so that nothing is lost silently.
    """
    lines = _lines(spark, path)
    name = F.when(F.col("line").startswith("PUBLIC_ID"), F.struct("at", F.get(F.split("line", r"\s+"), F.lit(1)).alias("id")))
    blocks = lines.groupBy("file", "seq").agg(F.max(F.when(F.col("line").startswith("# "), F.col("line"))).alias("head"), F.min(name)["id"].alias("public_id"))
    tokens = F.split(F.trim(F.regexp_replace("head", r"^#\s*", "")), r"\s+")
    b = blocks.withColumn("t", F.when(F.size(tokens) == 17, tokens))
    t = {n: F.get("t", F.lit(i)) for i, n in enumerate(HEADER)}
    whole = F.try_make_timestamp(*[t[n].try_cast("int") for n in HEADER[:5]], F.lit(0.0))
    us = F.unix_micros(whole) + F.floor(number(t["sec"]) * 1e6 + 0.5).cast("bigint")
    text = [F.when(~t[n].isin(*MISSING), t[n]).alias(n) for n in ("mag_type", "mag_author")]
    numbers = [number(t[n]).alias(n) for n in ("lat", "lon", "dep", "mag", "phase_count", "erh", "erv", "az_gap", "rms")]
    return b.select("file", "seq", us.alias("origin_us"), *numbers, *text, "public_id")


def read_picks(spark: SparkSession, path: str) -> DataFrame:
    """The pick lines of a bulletin: file, seq of the event, pick_seq and the typed pick columns."""
    p = _lines(spark, path).where(~F.col("line").startswith("# ") & ~F.col("line").startswith("PUBLIC_ID"))
    k = F.row_number().over(Window.partitionBy("file", "seq").orderBy("at"))
    return p.select("file", "seq", k.alias("pick_seq"), *[c.alias(n) for n, c in pick_columns(F.col("line")).items()])


def _text(c: Column, form: str) -> Column:
    return F.coalesce(F.format_string(form, c), F.lit("None")) if form != "%s" else F.coalesce(c, F.lit("None"))


def header_line(origin_us: Column, **c: Column) -> Column:
    """A header line; null values are written None. Takes the columns lat to rms by name."""
    when = F.timestamp_micros(origin_us)
    sec = F.pmod(origin_us, F.lit(60_000_000)) / 1e6
    forms = {"lat": "%.4f", "lon": "%.4f", "dep": "%.2f", "mag": "%.2f", "mag_type": "%s", "mag_author": "%s", "phase_count": "%.1f",
             "erh": "%.2f", "erv": "%.2f", "az_gap": "%.1f", "rms": "%.4f"}
    parts = [F.when(c[n].isNotNull(), _text(c[n], f)).otherwise("None") for n, f in forms.items()]
    clock = [F.year(when), F.month(when), F.dayofmonth(when), F.hour(when), F.minute(when)]
    return F.concat_ws(" ", F.lit("#"), *[x.cast("string") for x in clock], F.format_string("%.2f", sec), *parts)


def pick_line(us: Column, **c: Column) -> Column:
    """A pick line of fixed columns. Takes code, phase, err_s, channel and origin by name; null values are written ? or None."""
    when = F.timestamp_micros(us)
    pad = lambda x, n: F.rpad(F.coalesce(x, F.lit("None")), n, " ")
    sec = F.format_string("%06.3f", F.pmod(us, F.lit(60_000_000)) / 1e6)
    blank = F.lit("-1.00e+00")
    return F.concat_ws(
        " ", F.rpad(F.coalesce(c["code"], F.lit("?")), 9, " "), F.lit("?   "), F.lit("?   "), F.lit("?"), pad(c["phase"], 6), F.lit("?"),
        F.date_format(when, "yyyyMMdd"), F.date_format(when, "HHmm"), sec, F.lit("GAU"), F.rpad(F.format_string("%.2f", c["err_s"]), 9, " "),
        blank, blank, blank, F.lit("#"), pad(c["phase"], 6), pad(c["channel"], 4), pad(c["origin"], 9), F.lit("None"),
    )


def write(events: DataFrame, picks: DataFrame, path: str) -> None:
    """Writes blocks of header, public id and picks, each followed by an empty line, in the order of seq.

    events: seq, header, public_id (null = none). picks: seq, pick_seq, line.
    """
    lines = picks.groupBy("seq").agg(F.sort_array(F.collect_list(F.struct("pick_seq", "line"))).alias("p"))
    both = events.join(lines, "seq", "left")
    body = F.array_join(F.transform("p", lambda x: x["line"]), "\n")
    block = F.concat_ws("\n", "header", F.when(F.col("public_id").isNotNull(), F.concat(F.lit("PUBLIC_ID "), "public_id")), F.when(F.size("p") > 0, body), F.lit(""))
    both.repartitionByRange("seq").sortWithinPartitions("seq").select(block.alias("value")).write.text(path)

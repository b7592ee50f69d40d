"""Problem 1: magnitudes recorded in different units and on different scales.

Every distinct spelling of a unit (the text around the number, the remark, the
magnitude type) is mapped to a known unit once: an inverted index of character
bigrams gives the candidates, a weighted edit distance verifies them, and the
resulting alias dictionary is joined to all rows. The number itself is read with
JVM expressions; Python sees only distinct spellings.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.session import staged

# How authors name the units. kind, spelling, unit, magnitude type.
#   kind text = beside the number, note = in the remark, type = in mag_type
VOCABULARY = [
    ("text", "", "plain", None),
    ("text", "~", "plain", None),
    ("text", "(?)", "plain", None),
    ("text", "*", "plain", None),
    ("text", "M", "plain", None),
    ("text", "ML", "plain", "ml"),
    ("text", "MLv", "plain", "mlv"),
    ("text", "MD", "plain", "md"),
    ("text", "Mw", "plain", "mw"),
    ("text", "mbLg", "plain", "mblg"),
    ("text", "mb", "plain", "mb"),
    ("text", "x 0.01", "hundredth", None),
    ("text", "cM", "hundredth", None),
    ("text", "/100", "hundredth", None),
    ("text", "x 0.1", "tenth", None),
    ("text", "/10", "tenth", None),
    ("text", "dM", "tenth", None),
    ("text", "N m", "newton_metre", None),
    ("text", "Mo N m", "newton_metre", None),
    ("text", "dyn cm", "dyne_centimetre", None),
    ("text", "Mo dyn cm", "dyne_centimetre", None),
    ("text", "lg Mo N m", "lg_newton_metre", None),
    ("text", "log Mo N m", "lg_newton_metre", None),
    ("text", "lg Mo dyn cm", "lg_dyne_centimetre", None),
    ("text", "log Mo dyn cm", "lg_dyne_centimetre", None),
    ("note", "in hundredths", "hundredth", None),
    ("note", "centièmes", "hundredth", None),
    ("note", "centésimas de magnitud", "hundredth", None),
    ("note", "x100", "hundredth", None),
    ("note", "mag*100", "hundredth", None),
    ("note", "tenths", "tenth", None),
    ("note", "dixièmes de magnitude", "tenth", None),
    ("note", "en décimas", "tenth", None),
    ("note", "x10", "tenth", None),
    ("note", "mag*10", "tenth", None),
    ("note", "N m", "newton_metre", None),
    ("note", "M0 in N m", "newton_metre", None),
    ("note", "moment (N m)", "newton_metre", None),
    ("note", "moment sismique en N m", "newton_metre", None),
    ("note", "dyn cm", "dyne_centimetre", None),
    ("note", "M0 in dyn cm", "dyne_centimetre", None),
    ("note", "moment (dyn cm)", "dyne_centimetre", None),
    ("note", "moment sismique en dyn cm", "dyne_centimetre", None),
    ("type", "ML", "plain", "ml"),
    ("type", "MLv", "plain", "mlv"),
    ("type", "MD", "plain", "md"),
    ("type", "Mw", "plain", "mw"),
    ("type", "mbLg", "plain", "mblg"),
    ("type", "mb", "plain", "mb"),
    ("type", "M0", "moment", "mw"),
    ("type", "Mo", "moment", "mw"),
]
MISSING_VALUES = (-999.0, 9.9)  # fixed values: the sentinels of two source formats
LEAST_MAGNITUDE = -5.0
MOST_MAGNITUDE = 10.0
MAX_DISTANCE = 0.2  # of the edit distance over the longer spelling's letters and digits
SALTS = 16  # places of an alias, so that a remark on most rows is no single task
LEAST_SHARED = 0.4  # share of the shorter spelling's bigrams

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  "
_ACCENTS = ("àáâäèéêëìíîïòóôöùúûüçñ", "aaaaeeeeiiiioooouuuucn")
_NUMBER = r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"


def _tidy(mag: Column) -> Column:
    """One way of writing numbers: narrow digits, decimal points, e-notation, no uncertainty."""
    s = F.regexp_replace(F.translate(mag, _WIDE, _NARROW), r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"(?<=[0-9]),(?=[0-9])", ".")
    s = F.regexp_replace(s, r"\s*(?:±|\+/-)\s*[0-9.]+", "")
    s = F.regexp_replace(s, r"(?i)\bm0(?![.0-9])", "Mo")
    s = F.regexp_replace(s, r"(?i)log10", "log")
    s = F.regexp_replace(s, r"(?i)logM0(?![.0-9])", "log Mo")
    return F.regexp_replace(s, r"\s*[x×*·]\s*10\^([+-]?[0-9]+)", "e$1")


def _folded(spelling: Column) -> Column:
    """Case, accents and punctuation folded, for the bigrams only."""
    s = F.translate(F.lower(spelling), *_ACCENTS)
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}]+", " "))


def _bigrams(spelling: Column) -> Column:
    padded = F.concat(F.lit("^"), _folded(spelling), F.lit("$"))
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2)))
    )


def _weight(a: str, b: str) -> float:
    """Cost of writing b for a ('' = nothing): punctuation and case are cheap, digits dear."""
    if a == b:
        return 0.0
    if not (a + b).strip() or all(not c.isalnum() for c in a + b):
        return 0.03
    if a and b and a.lower().translate(_PLAIN) == b.lower().translate(_PLAIN):
        return 0.05
    if (a and a.isdigit()) or (b and b.isdigit()):
        return 3.0
    return 1.0


_PLAIN = str.maketrans(*_ACCENTS)


def weighted_distance(a: str, b: str) -> float:
    """Weighted edit distance over the number of letters and digits of the longer spelling."""
    row = [0.0]
    for y in b:
        row.append(row[-1] + _weight("", y))
    for x in a:
        last, row = row, [row[0] + _weight(x, "")]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + _weight(x, ""), row[j - 1] + _weight("", y), last[j - 1] + _weight(x, y)))
    size = max(sum(c.isalnum() for c in a), sum(c.isalnum() for c in b), 1)
    return row[-1] / size


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["distance"] = [weighted_distance(a, b) for a, b in zip(pdf["spelling"], pdf["known"], strict=True)]
        yield pdf[pdf["distance"] <= MAX_DISTANCE]


def vocabulary(spark: SparkSession) -> DataFrame:
    rows = [(i, *v) for i, v in enumerate(VOCABULARY)]
    return spark.createDataFrame(rows, "rank int, kind string, known string, unit string, scale string")


def alias_dictionary(spellings: DataFrame, known: DataFrame) -> DataFrame:
    """(kind, spelling) -> unit, scale for each distinct spelling that is near enough to a known one.

    spellings: distinct kind, spelling. known: rank, kind, known, unit, scale. Of several
    known spellings within MAX_DISTANCE the nearest counts, then the first in rank.
    Spellings near no known one are left out.
    """
    index = known.withColumn("grams", _bigrams(F.col("known"))).withColumn("known_grams", F.size("grams"))
    index = index.select("rank", "kind", "known", "unit", "scale", "known_grams", F.explode("grams").alias("gram"))
    probes = spellings.withColumn("grams", _bigrams(F.col("spelling"))).withColumn("own_grams", F.size("grams"))
    probes = probes.select("kind", "spelling", "own_grams", F.explode("grams").alias("gram"))
    pairs = (
        probes.join(index, ["kind", "gram"])
        .groupBy("kind", "spelling", "rank", "known", "unit", "scale", "own_grams", "known_grams")
        .agg(F.count("*").alias("shared"))
        .where(F.col("shared") >= LEAST_SHARED * F.least("own_grams", "known_grams"))
        .select("kind", "spelling", "rank", "known", "unit", "scale")
    )
    schema = "kind string, spelling string, rank int, known string, unit string, scale string, distance double"
    tasks = int(spellings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = pairs.repartition(tasks, "kind", "spelling").mapInPandas(_verify, schema)
    best = near.groupBy("kind", "spelling").agg(F.min(F.struct("distance", "rank", "unit", "scale")).alias("b"))
    return best.select("kind", "spelling", "b.unit", "b.scale")


def read_texts(mags: DataFrame) -> DataFrame:
    """(_mag, _value, _text) of each distinct text in mag that holds a number: the number and the spelling beside it."""
    parts = rf"^(.*?)({_NUMBER})(.*)$"
    before = F.regexp_extract("_tidy", parts, 1)
    after = F.regexp_extract("_tidy", parts, 3)
    text = F.regexp_replace(F.concat_ws(" ", F.trim(before), F.trim(after)), r"[=:()]+", " ")
    distinct = mags.where(F.col("mag").rlike("[0-9０-９]")).select(F.col("mag").alias("_mag")).distinct()
    read = distinct.withColumn("_tidy", _tidy(F.col("_mag")))
    read = read.select("_mag", F.regexp_extract("_tidy", parts, 2).try_cast("double").alias("_value"), F.trim(text).alias("_text"))
    return read.where(F.col("_value").isNotNull())


def to_local_magnitude(mags: DataFrame, models: DataFrame) -> DataFrame:
    """Each row's magnitude on the ML LDG scale: adds magnitude, unit, scale, ml, is_converted.

    mags: mag_id, mag, mag_type, mag_author, remark (others are kept). models: mag_type,
    mag_author, seg, slope, intercept. Rows without a usable number, with a missing-value
    mark or with an unknown unit beside the number get null in magnitude and ml. A null or
    unknown remark or type says nothing; a null author has no model. Empty tables give empty
    results; repeated rows stay repeated. Columns of mags named like an added one are replaced.
    """
    spark = mags.sparkSession
    note, kind = F.trim(F.coalesce("remark", F.lit(""))), F.trim(F.coalesce("mag_type", F.lit("")))
    whole = F.struct(*[F.col(f"`{c}`") for c in mags.columns]).alias("_row")
    rows = mags.select(whole, "mag", "mag_author", note.alias("_note"), kind.alias("_type"))
    texts = staged(read_texts(mags), "magnitude-texts")
    spelled = {"text": texts.select("_text"), "note": rows.select("_note"), "type": rows.select("_type")}
    spellings = [df.distinct().select(F.lit(k).alias("kind"), F.col(f"_{k}").alias("spelling")) for k, df in spelled.items()]
    aliases = staged(alias_dictionary(reduce(DataFrame.unionByName, spellings), vocabulary(spark)), "unit-aliases")

    def own(k: str) -> DataFrame:
        named = [F.col("spelling").alias(f"_{k}"), F.col("unit").alias(f"_{k}_unit"), F.col("scale").alias(f"_{k}_scale")]
        return aliases.where(F.col("kind") == k).select(*named)

    read = texts.join(own("text"), "_text", "left").drop("_text")
    # rows without a number meet no text, and must not meet in one task
    numeric = F.coalesce(F.col("mag").rlike("[0-9０-９]"), F.lit(False))
    blank = [F.lit(None).cast(kind).alias(c) for c, kind in read.dtypes]
    rows = rows.where(numeric).join(read, F.col("mag") == F.col("_mag"), "left").unionByName(rows.where(~numeric).select("*", *blank))
    # few remarks and types hold most rows: each alias is sent to SALTS places, a row to one
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("mag", "mag_author"), F.lit(SALTS)).cast("int"))
    for k in ("note", "type"):
        spread = own(k).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(spread, [f"_{k}", "_salt"], "left")
    value = F.col("_value")
    stated = F.when(F.col("_text_unit") != "plain", F.col("_text_unit")).when(
        F.col("_text_scale").isNull(), F.col("_note_unit")
    )
    # Beyond any magnitude and without a unit: hundredths, or a moment in SI units.
    silent = F.when(value.between(MOST_MAGNITUDE, 100 * MOST_MAGNITUDE), F.lit("hundredth")).when(
        value > 1e6, F.lit("newton_metre")
    )
    unit = F.coalesce(stated, silent, F.lit("plain"))
    moment = 2.0 / 3.0
    magnitude = (
        F.when(F.col("_text_unit").isNull() | value.isin(*MISSING_VALUES) | (value < LEAST_MAGNITUDE), None)
        .when(F.col("_unit") == "hundredth", value / 100)
        .when(F.col("_unit") == "tenth", value / 10)
        .when(F.col("_unit") == "newton_metre", moment * (F.log10(value) - 9.1))
        .when(F.col("_unit") == "dyne_centimetre", moment * (F.log10(value) - 7 - 9.1))
        .when(F.col("_unit") == "lg_newton_metre", moment * (value - 9.1))
        .when(F.col("_unit") == "lg_dyne_centimetre", moment * (value - 7 - 9.1))
        .when(value <= MOST_MAGNITUDE, value)
    )
    is_moment = F.col("_unit").rlike("metre")
    rows = rows.withColumn("_unit", unit).withColumn("_magnitude", magnitude)
    rows = rows.withColumn("_scale", F.when(is_moment, "mw").otherwise(F.coalesce("_text_scale", "_type_scale")))
    rows = rows.withColumn("_author", F.lower(F.trim("mag_author"))).withColumn(
        "_seg", F.when(F.col("_magnitude") >= 2, ">=2").otherwise("<2")
    )
    model = models.select(
        F.lower(F.trim("mag_type")).alias("_scale"),
        F.lower(F.trim("mag_author")).alias("_author"),
        F.col("seg").alias("_seg"),
        F.col("slope").alias("_slope"),
        F.col("intercept").alias("_intercept"),
    )
    rows = rows.join(model, ["_scale", "_author", "_seg"], "left")
    as_number = F.col("mag").try_cast("double")
    m = F.col("_magnitude")
    ml = F.when(F.col("_slope").isNotNull(), F.col("_slope") * m + F.col("_intercept")).otherwise(m)
    converted = m.isNotNull() & (as_number.isNull() | (F.abs(as_number - m) > 1e-9))
    new = {"magnitude": m, "unit": F.col("_unit"), "scale": F.col("_scale"), "ml": ml, "is_converted": converted}
    old = [F.col(f"_row.`{c}`").alias(c) for c in mags.columns if c not in new]
    return rows.select(*old, *[c.alias(n) for n, c in new.items()])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quakeloom.session import table

    columns = ["mag_id", "mag", "mag_type", "mag_author", "remark"]
    rows = table(spark, sf_dir, "org_mag").select(*columns)
    done = to_local_magnitude(rows, table(spark, sf_dir, "mag_model"))
    return (
        done.where("is_converted")
        .select("mag_id", F.round(F.col("ml") * 100).cast("int").alias("ml_centi"))
        .distinct()
    )

import pytest

from quakeloom.operators import units

MODELS = [("MD", "LDG", ">=2", 0.929, -0.133), ("MD", "LDG", "<2", 0.9, -0.075), ("Mw", "RESIF", ">=2", 0.946, 0.291), ("Mw", "RESIF", "<2", 0.871, 0.441)]
SCHEMA = "mag_id bigint, mag string, mag_type string, mag_author string, remark string"


def _run(spark, rows):
    models = spark.createDataFrame(MODELS, "mag_type string, mag_author string, seg string, slope double, intercept double")
    return units.to_local_magnitude(spark.createDataFrame(rows, SCHEMA), models)


def test_writings(spark):
    cases = [
        ("1.20", "ML", "LDG", None, 1.2, False),
        (" 1.20", "ML", "LDG", None, 1.2, False),
        ("1,20", "ML", "LDG", None, 1.2, True),
        ("１．２０", "ML", "LDG", None, 1.2, True),
        ("120", "ML", "LDG", None, 1.2, True),
        ("12", "ML", "LDG", "en décimas", 1.2, True),
        ("120", "ML", "LDG", "centièmes", 1.2, True),
        ("120/100", "ML", "LDG", None, 1.2, True),
        ("12/10", "ML", "LDG", None, 1.2, True),
        ("12 x 0.1", "ML", "LDG", None, 1.2, True),
        ("120 cM", "ML", "LDG", None, 1.2, True),
        ("M1.20", "ML", "LDG", None, 1.2, True),
        ("~1.20", "ML", "LDG", None, 1.2, True),
        ("1.20 +/- 0.3", "ML", "LDG", None, 1.2, True),
        ("1.20", "ML", "LDG", "depth x10 m", 1.2, False),
        ("1.20", "ML", "LDG", "M0=3.55e+09 Nm", 1.2, False),
        ("1.20", "ML", "LDG", "M0 not determined", 1.2, False),
        ("1.20 MD", None, " ldg ", None, 0.9 * 1.2 - 0.075, True),
        ("1.20", "md ", "LDG", None, 0.9 * 1.2 - 0.075, False),
        ("M0=7.9433e+10 N.m", "Mo", "RESIF", None, 0.871 * 1.2 + 0.441, True),
        ("7.9433·10^17 dyn.cm", None, "RESIF", None, 0.871 * 1.2 + 0.441, True),
        ("7.9433e+17", None, "RESIF", "moment (dyne-cm)", 0.871 * 1.2 + 0.441, True),
        ("log10(M0)=10.9 N·m", "M0", "RESIF", None, 0.871 * 1.2 + 0.441, True),
        ("lg M0 17.9 dyn cm", "M0", "RESIF", None, 0.871 * 1.2 + 0.441, True),
    ]
    rows = _run(spark, [(i, *c[:4]) for i, c in enumerate(cases)]).collect()
    got = {r.mag_id: r for r in rows}
    for i, c in enumerate(cases):
        assert got[i].ml == pytest.approx(c[4], abs=1e-4), c
        assert got[i].is_converted == c[5], c


def test_unusable(spark):
    marks = [None, "", "***", "None", "nan", "-", "-999", "-999.0", "9.9", "1.2 furlongs per fortnight", "x" * 50_000]
    rows = _run(spark, [(i, m, "ML", "LDG", None) for i, m in enumerate(marks)]).collect()
    assert len(rows) == len(marks)
    assert all(r.ml is None and not r.is_converted for r in rows)


def test_nulls_repeats_and_empty(spark):
    rows = _run(spark, [(1, "110", None, None, None), (1, "110", None, None, None), (None, "1.0", None, None, "")])
    assert sorted((r.mag_id or 0, r.ml) for r in rows.collect()) == [(0, 1.0), (1, 1.1), (1, 1.1)]
    assert _run(spark, [(1, "1", "ML", "LDG", None)]).limit(0).count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    models = spark.createDataFrame([], "mag_type string, mag_author string, seg string, slope double, intercept double")
    assert units.to_local_magnitude(empty, models).count() == 0


def test_distance():
    assert units.weighted_distance("N·m", "N m") <= units.MAX_DISTANCE
    assert units.weighted_distance("dyne-cm", "dyn cm") <= units.MAX_DISTANCE
    assert units.weighted_distance("x10", "x100") > units.MAX_DISTANCE
    assert units.weighted_distance("mb", "mbLg") > units.MAX_DISTANCE
    assert units.weighted_distance("", "") == 0


def test_clashing_columns(spark):
    from pyspark.sql import functions as F

    mags = spark.createDataFrame([(1, "110", "ML", "LDG", None)], SCHEMA)
    for c in ("unit", "ml", "_unit", "_row", "kind", "slope", "a.b"):
        mags = mags.withColumn(c, F.lit("x"))
    models = spark.createDataFrame(MODELS, "mag_type string, mag_author string, seg string, slope double, intercept double")
    r = units.to_local_magnitude(mags.withColumn("mag", F.lit("110")), models.withColumn("remark", F.lit("y"))).first()
    assert (r.ml, r.unit, r["_unit"], r["a.b"]) == (1.1, "hundredth", "x", "x")

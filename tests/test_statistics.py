import random
from statistics import median

import numpy as np
import pytest

from quakeloom.functions import seismic
from quakeloom.operators import statistics
from pyspark.sql import functions as F


def test_grid_windows_against_all_cells(spark):
    rng = random.Random(2)
    g = statistics.Grid(lat0=0.0, lon0=0.0, lat1=2.0, lon1=3.0, rows=8, cols=12, reach=2, least=3)
    events = [(rng.randrange(0, 41) / 16, rng.randrange(0, 57) / 16, float(rng.randrange(10)) if rng.random() < 0.9 else None) for _ in range(150)]
    got = {(r.i, r.j): (r.n, r.median) for r in statistics.grid_windows(spark.createDataFrame(events, "lat double, lon double, dep double"), "dep", g).collect()}
    want = {}
    for i in range(8):
        for j in range(12):
            low, high = max(i / 4 - 0.5, 0.0), min((i + 1) / 4 + 0.5, 2.0)
            west, east = max(j / 4 - 0.5, 0.0), min((j + 1) / 4 + 0.5, 3.0)
            inside = [d for a, b, d in events if low <= a <= high and west <= b <= east and d is not None]
            if len(inside) >= 3:
                want[i, j] = (len(inside), median(inside))
    assert got == want


def test_two_piece_fits(spark):
    rng = np.random.default_rng(3)
    x = rng.uniform(0.5, 5, 400)
    y = np.where(x >= 2, 0.9 * x + 0.1, 1.2 * (x - 2) + 1.9) + rng.normal(0, 0.05, 400)
    df = spark.createDataFrame([("a", float(p), float(q)) for p, q in zip(x, y, strict=True)], "k string, x double, y double")
    fit = statistics.two_piece_fits(df, ["k"]).first()
    up = x >= 2
    centred = np.column_stack([x[up] - x[up].mean(), y[up] - y[up].mean()])
    direction = np.linalg.svd(centred)[2][0]
    slope = direction[1] / direction[0]
    assert fit.slope == pytest.approx(slope) and fit.intercept == pytest.approx(y[up].mean() - slope * x[up].mean())
    pin = fit.slope * 2 + fit.intercept
    low = np.sum((x[~up] - 2) * (y[~up] - pin)) / np.sum((x[~up] - 2) ** 2)
    assert fit.slope_low == pytest.approx(low) and fit.intercept_low == pytest.approx(pin - 2 * low)


def test_ellipsoid_errors(spark):
    rng = np.random.default_rng(4)
    rows = [tuple(map(float, rng.uniform([0, -60, 1, 0, -60, 1, 1], [360, 60, 5, 360, 60, 5, 5]))) for _ in range(30)]
    df = spark.createDataFrame(rows, "az1 double, dip1 double, len1 double, az2 double, dip2 double, len2 double, len3 double")
    for r in seismic.with_ellipsoid_errors(df).collect():
        unit = lambda az, dip: np.array([np.cos(dip) * np.sin(az), np.cos(dip) * np.cos(az), np.sin(dip)])
        a, b = unit(*np.radians([r.az1, r.dip1])), unit(*np.radians([r.az2, r.dip2]))
        c = np.cross(a, b)
        axes = np.column_stack([a * r.len1, b * r.len2, c / np.linalg.norm(c) * r.len3])
        cov = axes @ axes.T
        assert r.erv == pytest.approx(np.sqrt(cov[2, 2])) and r.erh == pytest.approx(np.sqrt(np.linalg.eigvalsh(cov[:2, :2])[-1]))


def test_packed_statistics(spark):
    df = spark.createDataFrame([("Nan:5.0:Nan:7.0",), ("None:5.0",), ("Nan",), (None,)], "t string")
    s = seismic.packed(F.col("t"))
    assert [tuple(r) for r in df.select(seismic.first_of(s), seismic.mean_of(s)).collect()] == [(5.0, 6.0), (5.0, 5.0), (None, None), (None, None)]


def test_histograms(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.99, 1.0), (4.0, 0.5), (4.1, 0.5), (None, 0.5), (-0.1, 0.2)], "x double, y double")
    assert sorted(map(tuple, statistics.histogram(df, "x", 0.0, 4.0, 4).collect())) == [(0, 2), (3, 1)]
    assert sorted(map(tuple, statistics.histogram_2d(df, "x", "y", (0.0, 4.0), (0.0, 1.0), 2).collect())) == [(0, 0, 1), (0, 1, 1), (1, 1, 1)]


def test_ml_to_mw(spark):
    df = spark.createDataFrame([(2.0,), (3.5,), (4.0,), (5.0,)], "m double")
    assert [r[0] for r in df.select(seismic.ml_to_mw(F.col("m"))).collect()] == pytest.approx([1.7751, 2.9, 3.4, 5.0534])


def test_spearman_with_ties(spark):
    rng = random.Random(5)
    rows = [(float(rng.randrange(6)), float(rng.randrange(6))) for _ in range(80)]
    got = statistics.spearman(spark.createDataFrame(rows + [(None, 1.0), (2.0, None)], "x double, y double"), "x", "y").first()
    rank = lambda v: [sum(b < a for b in v) + (sum(b == a for b in v) + 1) / 2 for a in v]
    x, y = zip(*rows, strict=True)
    assert got.n == 80 and got.spearman == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1])


def test_quantiles_and_counts_over_partitions(spark):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=500), 2)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,), (float("nan"),)], "x double")
    shares = [0.0, 0.005, 0.25, 0.5, 0.99, 1.0]
    assert statistics.quantiles(df, "x", shares).first().q == pytest.approx(np.quantile(x, shares).tolist())
    assert statistics.quantiles(df.where("x > 100"), "x", [0.5]).first().q == [None]
    mags = spark.createDataFrame([(float(v),) for v in np.round(x, 1)] + [(None,)], "mag double")
    for r in statistics.cumulative_counts(mags).collect():
        assert r.n_at_least == int(np.sum(np.round(x, 1) >= r.mag - 1e-9))

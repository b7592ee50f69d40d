"""Catalog statistics: regressions, histograms, gridded medians, quantile cuts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.operators.bands import running_sums


@dataclass(frozen=True)
class Grid:
    """A map of rows x cols cells from (lat0, lon0); a cell's window reaches `reach` cells beyond it on all sides."""

    lat0: float = 42.0
    lon0: float = -2.25
    lat1: float = 44.0
    lon1: float = 3.5
    rows: int = 400
    cols: int = 860
    reach: int = 4
    least: int = 10


def grid_windows(events: DataFrame, value: str, grid: Grid | None = None, by: list[str] | None = None) -> DataFrame:
    """(by, i, j, n, median) of the value in each cell's window, cells of fewer than grid.least events left out.

    Events go to the cells whose windows they lie in (at most (2 reach + 2) squared), instead
    of every cell looking at all events. Windows include their edges; events outside the map
    are in none; null values do not count.
    """
    g = grid or Grid()
    by = by or []
    u = (F.col("lat") - g.lat0) * (g.rows / (g.lat1 - g.lat0))
    v = (F.col("lon") - g.lon0) * (g.cols / (g.lon1 - g.lon0))
    inside = F.col("lat").between(g.lat0, g.lat1) & F.col("lon").between(g.lon0, g.lon1) & F.col(value).isNotNull()

    def cells(x: Column, n: int) -> Column:
        first = F.greatest(F.ceil(x - g.reach - 1), F.lit(0))
        last = F.least(F.floor(x + g.reach), F.lit(n - 1))
        return F.explode(F.sequence(first.cast("int"), last.cast("int")))

    placed = events.where(inside).select(*by, F.col(value).alias("_value"), u.alias("_u"), v.alias("_v"))
    spread = placed.withColumn("i", cells(F.col("_u"), g.rows)).withColumn("j", cells(F.col("_v"), g.cols))
    found = spread.groupBy(*by, "i", "j").agg(F.count("*").alias("n"), F.median("_value").alias("median"))
    return found.where(F.col("n") >= g.least)


def cumulative_counts(mags: DataFrame) -> DataFrame:
    """(mag, n, n_at_least) for each distinct magnitude; the running sum is over distinct values only."""
    counts = mags.where(F.col("mag").isNotNull()).groupBy("mag").agg(F.count("*").alias("n"))
    return running_sums(counts, [F.col("mag").desc()], F.col("n"), "n_at_least")


def quantiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row with an array q of exact quantiles, interpolated between neighbours; nulls do not count.

    Distinct values are counted, range-partitioned and numbered by running sums; the values at
    the two places beside each quantile are picked out by number.
    """
    counts = df.where(F.col(column).isNotNull() & ~F.isnan(column)).groupBy(F.col(column).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    upto = running_sums(counts, [F.col("_v")], F.col("_n"), "_upto")
    total = upto.agg((F.max("_upto") - 1).alias("_last"))
    place = lambda p: F.lit(float(p)) * F.col("_last")
    wanted = F.array(*[F.struct(F.lit(k).alias("k"), side.alias("at")) for k, p in enumerate(shares) for side in (F.floor(place(p)), F.ceil(place(p)))])
    held = upto.join(F.broadcast(total)).select("_v", "_n", "_upto", "_last", F.explode(wanted).alias("w"))  # total is one row
    held = held.where((F.col("w.at") < F.col("_upto")) & (F.col("w.at") >= F.col("_upto") - F.col("_n")))
    own = lambda k: F.col("w.k") == k
    marks = []
    for k, p in enumerate(shares):
        low, high = F.min(F.when(own(k), F.col("_v"))), F.max(F.when(own(k), F.col("_v")))
        at = F.max(place(p))
        marks.append(low + (high - low) * (at - F.floor(at)))
    return held.agg(F.array(*marks).alias("q"))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin, n): equal bins, the last one closed on the right; what lies outside or is null is not counted."""
    width = (high - low) / bins
    inside = df.where(F.col(value).between(low, high))
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1)).cast("int")
    return inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def histogram_2d(df: DataFrame, x: str, y: str, x_range: tuple[float, float], y_range: tuple[float, float], bins: int) -> DataFrame:
    """(bx, by, n): as histogram, on two columns."""

    def at(c: str, r: tuple[float, float]) -> Column:
        return F.least(F.floor((F.col(c) - r[0]) / ((r[1] - r[0]) / bins)), F.lit(bins - 1)).cast("int")

    inside = df.where(F.col(x).between(*x_range) & F.col(y).between(*y_range))
    return inside.groupBy(at(x, x_range).alias("bx"), at(y, y_range).alias("by")).agg(F.count("*").alias("n"))


def central(df: DataFrame, columns: list[str], low: float, high: float) -> DataFrame:
    """The rows whose columns all lie between their exact quantiles low and high."""
    inside = df
    for c in columns:
        marks = quantiles(df, c, [low, high]).withColumnRenamed("q", "_q")
        kept = F.col(c).between(F.get("_q", F.lit(0)), F.get("_q", F.lit(1)))
        inside = inside.join(F.broadcast(marks)).where(kept).drop("_q")  # marks is one row
    return inside


def two_piece_fits(pairs: DataFrame, by: list[str], hinge: float = 2.0) -> DataFrame:
    """Lines y(x) by group: total least squares from the hinge up, below it a vertical fit pinned to the upper line.

    pairs: by, x, y. Gives n, slope, intercept, r2 (upper), slope_low, intercept_low (null without pairs below).
    One pass of moments for the upper line, one for the lower.
    """
    upper = pairs.where(F.col("x") >= hinge).groupBy(*by).agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"),
    )
    gap = F.col("syy") - F.col("sxx")
    slope = (gap + F.sqrt(gap * gap + 4 * F.col("sxy") * F.col("sxy"))) / (2 * F.col("sxy"))
    upper = upper.where(F.col("sxy") != 0).withColumn("slope", slope).withColumn("intercept", F.col("my") - F.col("slope") * F.col("mx"))
    residual = F.col("syy") - 2 * F.col("slope") * F.col("sxy") + F.col("slope") * F.col("slope") * F.col("sxx")
    upper = upper.select(*by, "n", "slope", "intercept", F.when(F.col("syy") > 0, 1 - residual / F.col("syy")).alias("r2"))
    pin = F.col("slope") * hinge + F.col("intercept")
    below = pairs.where(F.col("x") < hinge).join(upper.select(*by, pin.alias("pin")), by)
    low = below.groupBy(*by, "pin").agg(
        (F.sum((F.col("x") - hinge) * (F.col("y") - F.col("pin"))) / F.sum((F.col("x") - hinge) * (F.col("x") - hinge))).alias("slope_low")
    )
    low = low.select(*by, "slope_low", (F.col("pin") - F.col("slope_low") * hinge).alias("intercept_low"))
    return upper.join(low, by, "left")


def model_rows(fits: DataFrame, hinge: float = 2.0) -> DataFrame:
    """(mag_type, mag_author, seg, slope, intercept): two_piece_fits as the table of models, a row for each piece that is known."""
    piece = lambda seg, a, b: F.struct(F.lit(f"{seg}{hinge:g}").alias("seg"), F.col(a).alias("slope"), F.col(b).alias("intercept"))
    rows = fits.select("mag_type", "mag_author", F.explode(F.array(piece(">=", "slope", "intercept"), piece("<", "slope_low", "intercept_low"))).alias("p"))
    return rows.select("mag_type", "mag_author", "p.*").where(F.col("slope").isNotNull() & F.col("intercept").isNotNull())


def fit_diagnostics(pairs: DataFrame, by: list[str], hinge: float = 2.0) -> DataFrame:
    """Of each group's upper line (see two_piece_fits): n, sigma2, r2, band (sample deviation), bic, outliers.

    Outliers lie more than 1.5 quartile ranges outside the quartiles of the residuals.
    """
    lines = two_piece_fits(pairs, by, hinge).select(*by, "slope", "intercept")
    res = pairs.where(F.col("x") >= hinge).join(lines, by).withColumn("res", F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"))
    first = res.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.col("res") * F.col("res")).alias("sigma2"), F.stddev_samp("res").alias("band"), F.var_pop("y").alias("syy"),
        F.percentile("res", F.array(F.lit(0.25), F.lit(0.75))).alias("q"),
    )
    low, high = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    reach = 1.5 * (high - low) + 1e-9
    beyond = (F.col("res") < low - reach) | (F.col("res") > high + reach)
    counted = res.select(*by, "res").join(first.select(*by, "q"), by).groupBy(*by).agg(F.count(F.when(beyond, 1)).alias("outliers"))
    n, s2 = F.col("n"), F.col("sigma2")
    bic = 4 * F.log(n) + n * F.log(2 * F.pi() * s2) + n
    return first.join(counted, by).select(*by, "n", "sigma2", (1 - s2 / F.col("syy")).alias("r2"), "band", bic.alias("bic"), "outliers")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(n, spearman): rank correlation over rows that have both values, ties at their mean rank.

    Ranks come from the counts of distinct values by running sums over range partitions.
    """
    both = df.select(x, y).dropna()

    def ranks(c: str) -> DataFrame:
        counts = both.groupBy(c).agg(F.count("*").alias("_n"))
        upto = running_sums(counts, [F.col(c)], F.col("_n"), "_upto")
        return upto.select(c, (F.col("_upto") - F.col("_n") + (F.col("_n") + 1) / 2).alias(f"_{c}"))

    return both.join(ranks(x), x).join(ranks(y), y).agg(F.count("*").alias("n"), F.corr(f"_{x}", f"_{y}").alias("spearman"))

"""Magnitudes, errors, packed statistics and labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Networks of the permanent stations.
PERMANENT = ["FR", "RD", "RA", "ES", "CA", "LC"]


def ml_to_mw(ml: Column) -> Column:
    """Moment magnitude from local magnitude, in three pieces."""
    return F.when(ml < 3.117, 0.6642 * ml + 0.4467).when(ml <= 4.0, ml - 0.6).when(ml > 4.0, 1.4285 * ml - 2.0891)


def packed(token: Column) -> Column:
    """The slots of a packed statistic a:b:Nan as doubles, null where a source is absent."""

    def number(x: Column) -> Column:
        v = x.try_cast("double")
        return F.when(F.isnan(v), None).otherwise(v)

    return F.transform(F.split(token, ":"), number)


def first_of(slots: Column) -> Column:
    """The first slot that is not null."""
    return F.try_element_at(F.filter(slots, lambda v: v.isNotNull()), F.lit(1))


def mean_of(slots: Column) -> Column:
    """The mean of the slots that are not null."""
    known = F.filter(slots, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / F.size(known))


def pick_error(phase: Column) -> Column:
    """Reading error in seconds by phase: 0.05 for P, 0.15 for S."""
    letter = F.upper(F.substring(phase, 1, 1))
    return F.when(letter == "P", 0.05).when(letter == "S", 0.15)


def network_class(network: Column) -> Column:
    return F.when(network.isin(*PERMANENT), "permanent").when(network == "AM", "citizen").otherwise("temporary")


def rounded_origin_us(us: Column) -> Column:
    """Microseconds rounded to 10 ms, half to even, carried over into the next minute."""
    return (F.bround(us / 1e4) * 10_000).cast("bigint")


def with_ellipsoid_errors(df: DataFrame) -> DataFrame:
    """df (az1, dip1, len1, az2, dip2, len2, len3) with erh and erv, the errors of the error ellipsoid given by two axes and the third's length.

    The third axis is at right angles to the other two; rows with a degenerate pair of axes are left out.
    The components are columns of their own, so that each is computed once.
    """
    kept = df.columns
    for n in ("1", "2"):
        az, dip = F.radians(f"az{n}"), F.radians(f"dip{n}")
        df = df.withColumns({f"_{n}x": F.cos(dip) * F.sin(az), f"_{n}y": F.cos(dip) * F.cos(az), f"_{n}z": F.sin(dip)})
    c = F.col
    df = df.withColumns({
        "_3x": c("_1y") * c("_2z") - c("_1z") * c("_2y"),
        "_3y": c("_1z") * c("_2x") - c("_1x") * c("_2z"),
        "_3z": c("_1x") * c("_2y") - c("_1y") * c("_2x"),
    })
    df = df.withColumn("_size", F.sqrt(c("_3x") * c("_3x") + c("_3y") * c("_3y") + c("_3z") * c("_3z"))).where("_size > 1e-12")
    df = df.withColumns({f"_3{a}": c(f"_3{a}") / c("_size") for a in "xyz"})

    def cov(a: str, b: str) -> Column:
        one, two, three = (c(f"len{n}") * c(f"len{n}") * c(f"_{n}{a}") * c(f"_{n}{b}") for n in "123")
        return one + two + three

    df = df.withColumns({"_a": cov("x", "x"), "_b": cov("x", "y"), "_c": cov("y", "y"), "_z": cov("z", "z")})
    half = (c("_a") - c("_c")) / 2
    erh = F.sqrt((c("_a") + c("_c")) / 2 + F.sqrt(half * half + c("_b") * c("_b")))
    return df.select(*[k for k in kept if k not in ("erh", "erv")], erh.alias("erh"), F.sqrt("_z").alias("erv"))


def interpolated(distance: Column, table: Column, field: str, step: float) -> Column:
    """Linear interpolation of a field in an array of structs sorted by distance, with rows every step km."""
    i = F.floor(distance / step).cast("int")
    low, high = F.get(table, i), F.get(table, F.least(i + 1, F.size(table) - 1))
    share = distance / step - i
    return F.when((distance >= 0) & (distance <= (F.size(table) - 1) * step), low[field] + share * (high[field] - low[field]))


def fixed(c: Column, digits: int = 6) -> Column:
    """c rounded half up by the same floating-point steps everywhere, so that engines agree."""
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)

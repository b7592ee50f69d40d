"""Joins on ranges: band joins by buckets, validity intervals, and global numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.session import staged


def band_join(
    left: DataFrame, right: DataFrame, left_us: str, right_us: str, low_us: int, high_us: int, keys: tuple[Column, Column] | None = None
) -> DataFrame:
    """All pairs with low_us <= right_us - left_us <= high_us, as an equi-join on time buckets.

    A range predicate alone would be a nested loop. Buckets are as wide as the band; a left
    row is sent to the buckets its band touches (two or three), a right row to its own, so that
    each pair meets once. Rows with a null time meet nothing. Column names must differ. keys: further keys that pairs
    must share, an array of each left row's and the one of each right row (cells of a map, a source).
    """
    width = max(high_us - low_us, 1)
    first, last = F.floor((F.col(left_us) + low_us) / width), F.floor((F.col(left_us) + high_us) / width)
    one = left.where(F.col(left_us).isNotNull()).withColumn("_bucket", F.explode(F.sequence(first, last)))
    two = right.where(F.col(right_us).isNotNull()).withColumn("_bucket", F.floor(F.col(right_us) / width))
    on = ["_bucket"]
    if keys is not None:
        one, two, on = one.withColumn("_key", F.explode(keys[0])), two.withColumn("_key", keys[1]), ["_bucket", "_key"]
    gap = F.col(right_us) - F.col(left_us)
    return one.join(two, on).where(gap.between(low_us, high_us)).drop(*on)


def running_sums(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """df with the sum of value over all rows up to this one in the given order, without one task sorting everything.

    Rows are range-partitioned, summed within the partition and shifted by the sums of
    the partitions before (one row each). The order must be total for the sums to be determined.
    """
    ranged = staged(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.sum("_value").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    within = F.sum("_value").over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # a row for each partition of the session's shuffle setting
    return ranged.join(F.broadcast(shifts), "_part").withColumn(name, within + F.col("_shift")).drop("_part", "_shift", "_value")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a gapless number from 1 in the given order, by running sums of ones."""
    return running_sums(df, order, F.lit(1), name)


def coded_times(picks: DataFrame, sites: DataFrame) -> DataFrame:
    """picks (code, us) with the site epochs of their code: site_id, ord, start_us, end_us (null = open)."""
    epochs = sites.select(
        F.col("code").alias("_code"),
        F.col("site_id"),
        F.unix_micros("start_ts").alias("start_us"),
        F.unix_micros("end_ts").alias("end_us"),
    )
    return picks.join(epochs, F.col("code") == F.col("_code")).drop("_code")


def remapped(picks: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """(key, site_id): a code's only epoch whatever its dates; of several, the only one with a start that holds the time."""
    held = (F.col("start_us") <= F.col("us")) & (F.col("end_us").isNull() | (F.col("us") <= F.col("end_us")))
    seen = coded_times(picks, sites).groupBy(key).agg(
        F.count("*").alias("n"),
        F.min("site_id").alias("only"),
        F.count(F.when(held, 1)).alias("n_held"),
        F.min(F.when(held, F.col("site_id"))).alias("held"),
    )
    chosen = F.when(F.col("n") == 1, F.col("only")).when(F.col("n_held") == 1, F.col("held"))
    return seen.select(key, chosen.alias("site_id")).where(F.col("site_id").isNotNull())


def by_priority(picks: DataFrame, sites: DataFrame, key: str, day_us: Column) -> DataFrame:
    """(key, site_id, fallback): the epoch bounded on both sides that holds the day, else bounded on one side, else unbounded, else the last one."""
    start, end = F.col("start_us"), F.col("end_us")
    holds = (start.isNull() | (start <= day_us)) & (end.isNull() | (day_us <= end))
    bounds = start.isNotNull().cast("int") + end.isNotNull().cast("int")
    rank = F.when(holds, 2 - bounds).otherwise(3)
    order = F.when(rank < 3, F.struct(rank, F.col("site_id")))
    best = coded_times(picks, sites).groupBy(key).agg(F.min(order).alias("b"), F.max("site_id").alias("last"))
    return best.select(key, F.coalesce("b.site_id", "last").alias("site_id"), F.col("b").isNull().alias("fallback"))


def only_active(picks: DataFrame, sites: DataFrame, key: str) -> DataFrame:
    """(key, site_id) where exactly one epoch is active in the pick's minute."""
    minute = F.floor(F.col("us") / 60_000_000) * 60_000_000
    active = (F.col("start_us").isNull() | (F.col("start_us") <= minute)) & (F.col("end_us").isNull() | (minute <= F.col("end_us")))
    found = coded_times(picks, sites).where(active).groupBy(key).agg(F.count("*").alias("n"), F.min("site_id").alias("site_id"))
    return found.where(F.col("n") == 1).select(key, "site_id")

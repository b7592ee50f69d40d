"""The station inventory: epochs of one code, clusters of neighbours, new codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quakeloom.operators.matching import linked_groups
from quakeloom.operators.regions import near_points


def merged_stations(sites: DataFrame) -> DataFrame:
    """One row per code: earliest start, latest end (null = open), first elevation that is not 0, number of epochs."""
    oldest = F.struct(F.coalesce("start_ts", F.to_timestamp(F.lit("1900-01-01"))).alias("s"), F.col("site_id"))
    high = F.min(F.when(F.col("elevation") != 0, F.struct(oldest, F.col("elevation").alias("e"))))
    return sites.groupBy("network", "code").agg(
        F.count("*").alias("epochs"),
        F.min("start_ts").alias("start_ts"),
        F.when(F.count("end_ts") == F.count("*"), F.max("end_ts")).alias("end_ts"),
        F.coalesce(high["e"], F.lit(0.0)).alias("elevation"),
        F.min(oldest)["site_id"].alias("oldest_site"),
    )


def numbered_codes(sites: DataFrame) -> DataFrame:
    """(code, alt_code): NET.0000, NET.0001, ... in the order of the first site_id of each network's codes."""
    first = sites.groupBy("network", "code").agg(F.min("site_id").alias("first"))
    w = Window.partitionBy("network").orderBy("first")
    return first.select("code", F.format_string("%s.%04d", "network", F.row_number().over(w) - 1).alias("alt_code"))


def neighbours(sites: DataFrame, km: float) -> DataFrame:
    """(site_a, site_b), a < b: sites at most km apart."""
    at = sites.select(F.col("site_id").alias("site_a"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    there = sites.select(F.col("site_id").alias("site_b"), "latitude", "longitude")
    return near_points(at, "site_a", there, "site_b", km).where(F.col("site_a") < F.col("site_b")).distinct()


def site_clusters(sites: DataFrame, km: float, same_code: bool) -> DataFrame:
    """(site_id, cluster): sites linked by steps of at most km, within one code or over all networks; singles left out.

    cluster is the least site_id. With same_code only sites of one code are linked.
    """
    pairs = neighbours(sites, km)
    code = sites.select("site_id", "code")
    pairs = pairs.join(code.select(F.col("site_id").alias("site_a"), F.col("code").alias("code_a")), "site_a")
    pairs = pairs.join(code.select(F.col("site_id").alias("site_b"), F.col("code").alias("code_b")), "site_b")
    if same_code:
        pairs = pairs.where(F.col("code_a") == F.col("code_b"))
    groups = linked_groups(pairs.select(F.col("site_a").alias("id1"), F.col("site_b").alias("id2")))
    return groups.select(F.col("id").alias("site_id"), F.col("group_id").alias("cluster"))


def delays_by_station(delays: DataFrame, codes: DataFrame) -> DataFrame:
    """Each delay (sta, ...) with every alt_code of its station in a code map (alt_code, code), null and flagged missing if it has none."""
    blocks = codes.select("alt_code", F.col("code").alias("sta")).distinct()
    return delays.join(blocks, "sta", "left").withColumn("missing", F.col("alt_code").isNull())


def without_stations(sites: DataFrame, removal: DataFrame) -> DataFrame:
    """sites without those of a removal table (network, station); a null in the table removes nothing."""
    return sites.join(removal.select("network", "station").distinct(), ["network", "station"], "left_anti")


def renamed_sites(sites: DataFrame, km: float) -> DataFrame:
    """(site_id, code): the sites of a code that are not linked by steps of at most km get code_1, code_2, ... by their clusters' least site_id."""
    clusters = site_clusters(sites, km, same_code=True)
    own = sites.select("site_id", "code").distinct().join(clusters, "site_id", "left").withColumn("cluster", F.coalesce("cluster", "site_id"))
    k = F.dense_rank().over(Window.partitionBy("code").orderBy("cluster")) - 1
    return own.withColumn("k", k).select("site_id", F.when(F.col("k") == 0, F.col("code")).otherwise(F.concat_ws("_", "code", "k")).alias("code"))

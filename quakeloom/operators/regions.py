"""Problem 4: points near other points, and the regions that contain points.

Nearness: latitude strips with longitude cells as wide as the distance, one equi-join,
then the exact distance. Containment: crossing parity. Polygon edges are binned into
latitude strips and joined with the points of the strip; the ray crossings of each point
and region are grouped, an odd number is inside; points on an edge count as inside by an
explicit test.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions.geo import EARTH_KM, haversine_km
from quakeloom.session import table

KM_PER_DEGREE = math.pi * EARTH_KM / 180.0
STRIP_DEGREES = 0.25  # height of the latitude strips of polygon edges
SALTS = 16  # places of a strip


def _strip(lat: Column, height: float) -> Column:
    return F.floor((lat + 90.0) / height).cast("int")


def _cells_around(strip: Column, height: float) -> Column:
    """Number of longitude cells of a strip, each at least as wide as the strip is high."""
    far = F.greatest(F.abs(strip * height - 90.0), F.abs((strip + 1) * height - 90.0))
    share = F.cos(F.radians(F.least(far, F.lit(90.0))))
    return F.greatest(F.floor(360.0 * share / height), F.lit(1)).cast("int")


def _cell(lon: Column, cells: Column) -> Column:
    turned = F.pmod(lon + 180.0, F.lit(360.0))
    return F.least(F.floor(turned * cells / 360.0).cast("int"), cells - 1)


def _lon_reach(strip: Column, degrees: float) -> Column:
    """Degrees of longitude that a circle of that radius spans at most from a latitude strip of twice its height; 180 near a pole."""
    far = F.least(F.greatest(F.abs(strip * (2 * degrees)), F.abs((strip + 1) * (2 * degrees))), F.lit(90.0))
    share = math.sin(math.radians(degrees)) / F.cos(F.radians(far))
    return F.when((F.cos(F.radians(far)) > 1e-9) & (share < 1), F.degrees(F.asin(F.least(share, F.lit(1.0)))) * 1.0001).otherwise(180.0)


def own_cell(lat: Column, lon: Column, degrees: float) -> Column:
    """The cell (y, x) that a point lies in: latitude strips and longitude cells, each at least twice the radius wide."""
    y = F.floor(lat / (2 * degrees))
    n = F.greatest(F.floor(180.0 / _lon_reach(y, degrees)), F.lit(1))
    x = F.pmod(F.floor(F.pmod(lon + 180.0, F.lit(360.0)) * n / 360.0), n)
    return F.struct(y.alias("y"), x.alias("x"))


def touched_cells(lat: Column, lon: Column, degrees: float) -> Column:
    """The cells (see own_cell) that a circle around a point touches, across the 180th meridian and the poles: one to four as a rule."""

    def cells(y: Column) -> Column:
        reach = _lon_reach(y, degrees)
        n = F.greatest(F.floor(180.0 / reach), F.lit(1))
        turned = F.pmod(lon + 180.0, F.lit(360.0))
        around = F.sequence(F.floor((turned - reach) * n / 360.0), F.floor((turned + reach) * n / 360.0))
        return F.array_distinct(F.transform(around, lambda c: F.struct(y.alias("y"), F.pmod(c, n).alias("x"))))

    return F.flatten(F.transform(F.sequence(F.floor((lat - degrees) / (2 * degrees)), F.floor((lat + degrees) / (2 * degrees))), cells))


def near_points(points: DataFrame, point_id: str, places: DataFrame, place_id: str, km: float) -> DataFrame:
    """(point_id, place_id) of all places at most km from a point (great circle, 6371 km).

    points have lat and lon, places latitude and longitude; other columns are ignored. A
    null or not finite coordinate, or a latitude beyond 90 degrees, is near nothing. Distances
    across the 180th meridian and over the poles count. Repeated rows give repeated pairs.
    """
    height = km / KM_PER_DEGREE * 1.0001
    p = points.select(F.col(point_id).alias("_p"), F.col("lat").alias("_plat"), F.col("lon").alias("_plon"))
    p = p.where(F.col("_plat").between(-90, 90) & (F.abs("_plon") < float("inf")))
    p = p.withColumn("_strip", _strip(F.col("_plat"), height))
    p = p.withColumn("_cell", _cell(F.col("_plon"), _cells_around(F.col("_strip"), height)))
    q = places.select(F.col(place_id).alias("_q"), F.col("latitude").alias("_qlat"), F.col("longitude").alias("_qlon"))
    q = q.where(F.col("_qlat").between(-90, 90) & (F.abs("_qlon") < float("inf")))
    own = _strip(F.col("_qlat"), height)
    q = q.withColumn("_strip", F.explode(F.sequence(own - 1, own + 1)))
    q = q.withColumn("_n", _cells_around(F.col("_strip"), height))
    at = _cell(F.col("_qlon"), F.col("_n"))
    around = F.array_distinct(F.transform(F.sequence(at - 1, at + 1), lambda c: F.pmod(c, F.col("_n"))))
    # near a pole a strip is shorter than three cells of its neighbour: take all its cells
    around = F.when(F.col("_n") <= 8, F.sequence(F.lit(0), F.col("_n") - 1)).otherwise(around)
    q = q.withColumn("_cell", F.explode(around)).drop("_n")
    both = p.join(q, ["_strip", "_cell"])
    d = haversine_km(F.col("_plat"), F.col("_plon"), F.col("_qlat"), F.col("_qlon"))
    return both.where(d <= km).select(F.col("_p").alias(point_id), F.col("_q").alias(place_id))


def box_edges(boxes: DataFrame, region_id: str) -> DataFrame:
    """The four edges (region_id, lat1, lon1, lat2, lon2) of latitude and longitude boxes."""
    lo, la = ("lon_min", "lon_max"), ("lat_min", "lat_max")
    corners = [(la[0], lo[0]), (la[0], lo[1]), (la[1], lo[1]), (la[1], lo[0])]
    sides = [
        F.struct(
            F.col(a[0]).alias("lat1"), F.col(a[1]).alias("lon1"), F.col(b[0]).alias("lat2"), F.col(b[1]).alias("lon2")
        )
        for a, b in zip(corners, corners[1:] + corners[:1], strict=True)
    ]
    return boxes.select(region_id, F.explode(F.array(*sides)).alias("e")).select(region_id, "e.*")


def containing_regions(points: DataFrame, point_id: str, edges: DataFrame, region_id: str) -> DataFrame:
    """(point_id, region_id) of all regions that contain a point, edges and corners included.

    edges: region_id, lat1, lon1, lat2, lon2, the sides of simple polygons in either direction
    (holes are further rings). A ray runs from the point to greater longitudes; a side is
    crossed if one end is above the point's latitude and the other is not. Sides with a null
    coordinate are ignored, points with one are in no region. Each pair comes once, also for
    repeated points.
    """
    e = edges.where(F.col("lat1").isNotNull() & F.col("lon1").isNotNull() & F.col("lat2").isNotNull() & F.col("lon2").isNotNull())
    low, high = F.least("lat1", "lat2"), F.greatest("lat1", "lat2")
    e = e.select(
        F.col(region_id).alias("_r"),
        "lat1",
        "lon1",
        "lat2",
        "lon2",
        low.alias("_low"),
        high.alias("_high"),
        F.greatest("lon1", "lon2").alias("_east"),
        F.explode(F.sequence(_strip(low, STRIP_DEGREES), _strip(high, STRIP_DEGREES))).alias("_strip"),
    ).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    p = points.select(F.col(point_id).alias("_p"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon")).distinct()
    p = p.where(F.col("_lat").isNotNull() & F.col("_lon").isNotNull())
    # most points lie in a few strips: each strip's sides are sent to SALTS places, a point to one
    p = p.withColumn("_strip", _strip(F.col("_lat"), STRIP_DEGREES)).withColumn("_salt", F.pmod(F.xxhash64("_p", "_lat", "_lon"), F.lit(SALTS)).cast("int"))
    # sides west of the point can be neither crossed nor touched
    both = p.join(e, ["_strip", "_salt"]).where(F.col("_lat").between(F.col("_low"), F.col("_high")) & (F.col("_lon") <= F.col("_east")))
    turn = (F.col("lon2") - F.col("lon1")) * (F.col("_lat") - F.col("lat1")) - (F.col("_lon") - F.col("lon1")) * (
        F.col("lat2") - F.col("lat1")
    )
    upward = F.col("lat2") > F.col("lat1")
    spans = (F.col("lat1") > F.col("_lat")) != (F.col("lat2") > F.col("_lat"))
    crossed = spans & F.when(upward, turn > 0).otherwise(turn < 0)
    touched = (turn == 0) & F.col("_lon").between(F.least("lon1", "lon2"), F.col("_east"))
    hits = both.groupBy("_p", "_lat", "_lon", "_r").agg(
        F.sum(crossed.cast("int")).alias("crossings"), F.max(touched).alias("touched")
    )
    inside = hits.where((F.col("crossings") % 2 == 1) | F.col("touched"))
    return inside.select(F.col("_p").alias(point_id), F.col("_r").alias(region_id)).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "catalog_event").select("event_uid", "lat", "lon")
    sites = table(spark, sf_dir, "station_site").select("site_id", "latitude", "longitude")
    zones = table(spark, sf_dir, "reloc_zone")
    near = near_points(events, "event_uid", sites, "site_id", 3.0).select("event_uid", F.col("site_id").alias("place_id"))
    within = containing_regions(events, "event_uid", box_edges(zones, "zone_id"), "zone_id")
    return near.unionByName(within.select("event_uid", F.col("zone_id").alias("place_id"))).distinct()

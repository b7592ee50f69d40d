import math
import random

from quakeloom.operators import regions


def _km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    return 2 * 6371 * math.asin(min(1, math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2)))


def test_near_points_against_all_pairs(spark):
    rng = random.Random(1)
    centres = [(42.5, 0.0), (0.0, 179.99), (89.9, 10.0), (-89.95, -170.0), (60.0, -180.0)]
    near = lambda: (lambda c: (max(-90.0, min(90.0, c[0] + rng.gauss(0, 0.05))), c[1] + rng.gauss(0, 0.1)))(rng.choice(centres))
    points = [(i, *near()) for i in range(300)] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 42.5, None)]
    places = [(f"S{i}", *near()) for i in range(120)] + [("X", None, None)]
    p = spark.createDataFrame(points, "id bigint, lat double, lon double")
    q = spark.createDataFrame(places, "site string, latitude double, longitude double")
    for km in (3.0, 25.0):
        got = sorted(map(tuple, regions.near_points(p, "id", q, "site", km).collect()))
        want = sorted((i, s) for i, a, b in points[:300] for s, c, d in places[:120] if _km(a, b, c, d) <= km)
        assert got == want


def test_boxes_with_edges(spark):
    boxes = spark.createDataFrame([("A", 0.0, 0.0, 1.0, 2.0), ("B", 1.0, 1.0, 3.0, 3.0)], "zone string, lat_min double, lon_min double, lat_max double, lon_max double")
    grid = [(i, a / 2, b / 2) for i, (a, b) in enumerate((a, b) for a in range(-1, 8) for b in range(-1, 8))]
    points = spark.createDataFrame(grid + grid[:5] + [(777, None, 1.0)], "id bigint, lat double, lon double")
    got = sorted(map(tuple, regions.containing_regions(points, "id", regions.box_edges(boxes, "zone"), "zone").collect()))
    want = sorted([(i, "A") for i, a, b in grid if 0 <= a <= 1 and 0 <= b <= 2] + [(i, "B") for i, a, b in grid if 1 <= a <= 3 and 1 <= b <= 3])
    assert got == want


def test_polygon_with_hole(spark):
    ring = lambda pts: [(a, b, c, d) for (a, b), (c, d) in zip(pts, pts[1:] + pts[:1], strict=True)]
    sides = ring([(0, 0), (0, 4), (4, 4), (2, 2), (4, 0)]) + ring([(0.5, 1.5), (0.5, 2.5), (1.5, 2.0)])
    edges = spark.createDataFrame([("P", *map(float, s)) for s in sides], "r string, lat1 double, lon1 double, lat2 double, lon2 double")
    points = [(1, 0.25, 2.0), (2, 0.8, 2.0), (3, 3.0, 2.0), (4, 3.0, 0.5), (5, 2.0, 2.0), (6, 0.5, 2.0), (7, 4.0, 4.0), (8, 5.0, 0.0)]
    got = sorted(r.id for r in regions.containing_regions(spark.createDataFrame(points, "id bigint, lat double, lon double"), "id", edges, "r").collect())
    assert got == [1, 4, 5, 6, 7]


def test_empty(spark):
    points = spark.createDataFrame([], "id bigint, lat double, lon double")
    boxes = spark.createDataFrame([], "zone string, lat_min double, lon_min double, lat_max double, lon_max double")
    assert regions.containing_regions(points, "id", regions.box_edges(boxes, "zone"), "zone").count() == 0


def test_cells_hold_all_near_pairs(spark):
    """Every pair within the reach shares exactly one cell, across the 180th meridian and at the poles too."""
    import random

    from pyspark.sql import functions as F

    from quakeloom.functions.geo import haversine_km
    from quakeloom.operators.regions import KM_PER_DEGREE, own_cell, touched_cells

    rng = random.Random(5)
    at = [(rng.choice([0, 42, 60, 89, -89.9, 90]) + rng.uniform(-1, 1), rng.choice([0, 179.9, -180, 3]) + rng.uniform(-1, 1)) for _ in range(150)]
    at = [(max(-90.0, min(90.0, y)), (x + 180) % 360 - 180) for y, x in at]
    rows = spark.createDataFrame([(i, y, x) for i, (y, x) in enumerate(at)], "id int, lat double, lon double")
    degrees = 50 / KM_PER_DEGREE * 1.0001
    one = rows.select(F.col("id").alias("a"), F.col("lat").alias("y1"), F.col("lon").alias("x1"), F.explode(touched_cells(F.col("lat"), F.col("lon"), degrees)).alias("c"))
    two = rows.select(F.col("id").alias("b"), F.col("lat").alias("y2"), F.col("lon").alias("x2"), own_cell(F.col("lat"), F.col("lon"), degrees).alias("c"))
    km = haversine_km(F.col("y1"), F.col("x1"), F.col("y2"), F.col("x2"))
    got = [(r.a, r.b) for r in one.join(two, "c").where(km <= 50).collect()]
    cross = rows.select(F.col("id").alias("a"), F.col("lat").alias("y1"), F.col("lon").alias("x1")).join(rows.select(F.col("id").alias("b"), F.col("lat").alias("y2"), F.col("lon").alias("x2")))
    want = [(r.a, r.b) for r in cross.where(km <= 50).collect()]
    assert sorted(got) == sorted(want) and len(want) > 150

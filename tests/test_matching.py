import os
import random

import pytest
from pyspark.sql import functions as F

from quakeloom.operators import bands, matching
from quakeloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def _catalog(spark, rng, n, first=0):
    rows = [(first + i, rng.randrange(0, 400) * 500_000, 42.5 + rng.random() * 0.6, 0.5 + rng.random() * 0.6, rng.choice([1.0, 2.0, 3.0, None]), rng.choice(["ML", "MLv"]), rng.choice(["LDG", "OMP", "RESIF"])) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, us bigint, lat double, lon double, mag double, mag_type string, mag_author string")


def _greedy(pairs):
    used1, used2, out = set(), set(), []
    for phase, strict in (("strict", True), ("loose", False)):
        for r in sorted((r for r in pairs if r.strict == strict), key=lambda r: (r.cost, r.id1, r.id2)):
            if r.id1 not in used1 and r.id2 not in used2:
                used1.add(r.id1)
                used2.add(r.id2)
                out.append((r.id1, r.id2, phase))
    return sorted(out)


def test_two_phase_is_the_greedy_order(spark):
    rng = random.Random(4)
    pairs = matching.candidates(_catalog(spark, rng, 60), _catalog(spark, rng, 60, 1000))
    rows = pairs.collect()
    assert any(r.strict for r in rows) and any(r.is_ml and r.dt_s <= 2 and not r.strict for r in rows)
    got = sorted((r.id1, r.id2, r.phase) for r in matching.two_phase(pairs).collect())
    assert got == _greedy(rows)


def test_bounds_of_candidates(spark):
    schema = "id bigint, us bigint, lat double, lon double"
    one = spark.createDataFrame([(1, 0, 42.0, 0.0), (9, None, 42.0, 0.0)], schema)
    two = spark.createDataFrame([(2, 30_000_000, 42.0, 0.0), (3, 29_999_999, 42.0, 0.0), (4, -2_000_000, 42.0, 0.0), (5, 0, 43.0, 0.0), (6, 0, None, 0.0)], schema)
    got = {r.id2: r.strict for r in matching.candidates(one, two).collect()}
    assert got == {3: False, 4: True}


def test_band_join_is_the_nested_loop(spark):
    rng = random.Random(5)
    a, b = [rng.randrange(-500, 500) for _ in range(80)] + [None], [rng.randrange(-500, 500) for _ in range(80)] + [None]
    left, right = (spark.createDataFrame([(i, v) for i, v in enumerate(x)], f"{n} bigint, {n}_us bigint") for n, x in (("l", a), ("r", b)))
    for low, high in ((-7, 7), (0, 60), (-60, -5), (0, 0)):
        got = sorted((r.l, r.r) for r in bands.band_join(left, right, "l_us", "r_us", low, high).collect())
        want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x is not None and y is not None and low <= y - x <= high)
        assert got == want


def test_numbering_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    got = bands.numbered(df, [F.col("v")], "k").collect()
    assert [r.k for r in sorted(got, key=lambda r: r.v)] == list(range(1, 1001))


def test_linked_groups_are_the_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 40)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(45)]
    edges = [(a, b) for a, b in edges if a != b]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = {r.id: r.group_id for r in matching.linked_groups(spark.createDataFrame(edges, "id1 bigint, id2 bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert matching.linked_groups(spark.createDataFrame([], "id1 bigint, id2 bigint")).count() == 0


def test_doubles(spark):
    rows = [(1, "A", 0, 42.0, 0.0, 5.0), (2, "A", 100_000, 42.01, 0.0, None), (3, "B", 0, 42.0, 0.0, 5.0), (4, "A", 5_000_000, 42.0, 0.0, 5.0), (5, "A", 5_900_000, 42.0, 0.3, 5.0), (6, "A", 6_500_000, 42.0, 0.3, 5.0), (7, "A", 0, None, 0.0, 1.0)]
    pairs = matching.double_pairs(spark.createDataFrame(rows, "id bigint, source string, us bigint, lat double, lon double, dep double"))
    groups = {r.id: (r.group_id, r.members, r.action) for r in matching.double_groups(pairs).collect()}
    assert groups == {1: (1, 2, "merge"), 2: (1, 2, "merge"), 4: (4, 3, "review"), 5: (4, 3, "review"), 6: (4, 3, "review")}


def test_fusion_keeps_every_event_once(spark):
    rng = random.Random(7)
    catalogs = [_catalog(spark, rng, 30, 1000 * k).withColumn("dep", F.lit(5.0)) for k in range(3)]
    done = matching.fused(catalogs).collect()
    members = sorted(m for r in done for m in r.members)
    assert members == sorted(1000 * k + i for k in range(3) for i in range(30))
    for r in done:
        assert len(r.lats) == len(r.mags) == 3
        assert [x is not None for x in r.lats] == [any(m // 1000 == k for m in r.members) for k in range(3)]


def test_loose_matches_need_a_shared_reading(spark):
    schema = "id bigint, us bigint, lat double, lon double, dep double"
    one = spark.createDataFrame([(1, 0, 42.0, 0.0, 1.0), (2, 600_000_000, 42.0, 0.0, 1.0)], schema)
    two = spark.createDataFrame([(11, 10_000_000, 42.0, 0.0, 1.0), (12, 610_000_000, 42.0, 0.0, 1.0)], schema)
    picks = spark.createDataFrame([(1, 1, "A.B", "P", 100), (11, 1, "A.B", "P", 900_000), (2, 1, "A.B", "S", 5), (12, 1, "A.B", "S", 5)], "event_uid bigint, pick_seq int, code string, phase string, us bigint")
    assert sorted(r.members for r in matching.fused([one, two], picks).collect()) == [[1, 11], [2], [12]]


def test_time_unique(spark):
    one = spark.createDataFrame([(1, 0, 5), (2, 100, 6), (3, 1000, 7), (4, 1003, 8), (5, 98, 9)], "id bigint, us bigint, seq bigint")
    two = spark.createDataFrame([(11, 5), (12, 101), (13, 109), (14, 1010), (15, 1020)], "id bigint, us bigint")
    # 2 has two; 3 takes 14, so that 4 has none; 5 has 12 alone, since 13 is too far
    assert [tuple(r) for r in matching.time_unique(one, two, 10).orderBy("id1").collect()] == [(1, 11), (3, 14), (5, 12)]


def test_first_come_is_the_file_order(spark):
    rng = random.Random(8)
    rows = [(i, 1000 - 7 * i, 100 + j, float(rng.randrange(5)), float(rng.randrange(4))) for i in range(30) for j in range(30) if rng.random() < 0.12]
    pairs = spark.createDataFrame(rows, "id1 bigint, seq bigint, id2 bigint, km double, dt_s double")
    for only in (False, True):
        used, want = set(), []
        for i in sorted({r[0] for r in rows}, key=lambda i: 1000 - 7 * i):
            free = sorted((km, dt, j) for a, _, j, km, dt in rows if a == i and j not in used)
            if free and (not only or len(free) == 1):
                used.add(free[0][2])
                want.append((i, free[0][2]))
        assert sorted(map(tuple, matching.first_come(pairs, only).collect())) == sorted(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are absent")
def test_fusion_folds_every_source(spark):
    done = catalog.fuse_catalogs(spark, DATA).collect()
    members = sorted(int(m) for r in done for m in r.members.split(","))
    rows = spark.read.parquet(f"{DATA}/catalog_event.parquet").where("event_dt IS NOT NULL").select("event_uid").collect()
    assert members == sorted(r.event_uid for r in rows)

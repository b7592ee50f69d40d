import random

import pytest

from quakeloom.llm import nearest_time

LEAF = "id bigint, entity string, us bigint"
QUERY = "query_id bigint, entity string, us bigint"


def _brute(queries, leaves, tolerance):
    out = set()
    for q, e, t in set(queries):
        if None in (q, e, t):
            continue
        near = [(abs(u - t), i) for i, f, u in leaves if f == e and None not in (i, u) and abs(u - t) <= tolerance]
        if near:
            g, i = min(near)
            out.add((q, i, g))
    return sorted(out)


def _run(spark, queries, leaves, tolerance):
    got = nearest_time.nearest_in_time(spark.createDataFrame(queries, QUERY), spark.createDataFrame(leaves, LEAF), tolerance)
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("spread, tolerance", [(200, 7), (1 << 31, 1 << 26), (1 << 20, 1_500_000)])
def test_against_brute_force(spark, spread, tolerance):
    rng = random.Random(spread)
    base = (1 << 50) + (3 << nearest_time.BITS)  # around the edge of a block
    time = lambda: base + rng.randrange(-spread, spread)
    leaves = [(i, rng.choice("ab"), time()) for i in range(300)]
    queries = [(i, rng.choice("abc"), time()) for i in range(200)] + [(500 + i, e, u) for i, (_, e, u) in enumerate(leaves[:20])]
    assert _run(spark, queries, leaves, tolerance) == _brute(queries, leaves, tolerance)


def test_ties_repeats_and_nulls(spark):
    leaves = [(9, "a", 100), (3, "a", 100), (7, "a", 110), (7, "a", 110), (1, None, 105), (None, "a", 105), (2, "a", None), (4, "b", -5), (5, "b", 5)]
    queries = [(1, "a", 105), (1, "a", 105), (2, "a", 109), (3, None, 105), (4, "a", None), (None, "a", 105), (5, "c", 105), (6, "b", 0)]
    assert _run(spark, queries, leaves, 10) == [(1, 3, 5), (2, 7, 1), (6, 4, 5)]


def test_empty_and_bounds(spark):
    assert _run(spark, [], [(1, "a", 1)], 5) == [] and _run(spark, [(1, "a", 1)], [], 5) == []
    with pytest.raises(ValueError):
        _run(spark, [(1, "a", 1)], [(1, "a", 1)], 1 << nearest_time.BITS)


def test_a_frequent_entity(spark):
    leaves = [(i, "hot", i * 1000) for i in range(20_000)]
    queries = [(i, "hot", i * 977 + 400) for i in range(5_000)]
    got = {q: i for q, i, _ in _run(spark, queries, leaves, 1500)}
    assert got == {i: (i * 977 + 400 + 499) // 1000 for i in range(5_000)}


def test_pick_times(spark):
    import datetime as dt

    at = dt.datetime(2020, 1, 1)
    picks = spark.createDataFrame([(1, 1, " fr.abc.00 ", "pg", at, None), (2, 1, "FR.ABC", "S", None, 1.5), (3, 2, "FR.ABC", "P", None, 1.0), (4, 1, "FR.ABC", "P", None, None), (5, 1, None, "P", at, None)], "pick_id bigint, event_uid bigint, code string, phase string, arrival_ts timestamp, tt_s double")
    events = spark.createDataFrame([(1, at), (2, None)], "event_uid bigint, event_dt timestamp")
    got = {r.id: (r.entity, r.us) for r in nearest_time.pick_times(picks, events).collect()}
    us = 1_577_836_800_000_000
    assert got == {1: ("FR.ABC|P", us), 2: ("FR.ABC|S", us + 1_500_000), 5: (None, us)}

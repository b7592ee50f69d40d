"""Problem 3: match events of different sources that have no common key.

Soft logic: every candidate pair is a truth value between 0 and 1. Weighted rules say how
near in time and place two rows must be to be the same earthquake (squared hinges), and
that sameness is transitive: if x is y and y is z, then x is z (a hinge). Two rows of one
source are the same only if the network issued the event twice, which has its own weak
rule. Unless that rule holds them for such twins, a row is at most one of the two
(exclusivity, a hinge that outweighs the similarity of a perfect pair).
The convex problem is solved by alternating directions: every ground rule moves its own
copies of the values, every value is the mean of its copies, until both residuals are
below a tolerance. Rows that no chain of pairs connects do not bear on each other, so
the problem falls into parts: parts of bounded size are solved in blocks in numpy, larger
ones by window sums over the table of (rule, pair). Transitivity is grounded lazily, only
where the values so far break it, until no rule outside the table is broken. The value of
a pair is its confidence.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakeloom.functions.geo import haversine_km
from quakeloom.llm.components import connected_groups
from quakeloom.operators.regions import KM_PER_DEGREE
from quakeloom.session import cut, staged, table

OFFSET_S = 3.0  # bound of the usual time difference of two sources
BLOCK_ROWS = 100_000  # copies that are solved together in one Python task


@dataclass(frozen=True)
class Rules:
    """Weights of the rules: costs in units of log-odds. Chosen once for bulletin data."""

    prior: float = 7.5  # log-odds of a pair with no discrepancy
    scale_s: float = 0.6  # seconds that cost one unit
    scale_km: float = 5.0  # kilometres that cost one unit
    max_s: float = 8.0  # rows this near in time always meet
    minute_slip: float = 3.5  # cost of a time wrong by a whole minute
    sign_slip: float = 4.0  # cost of a longitude of wrong sign
    swap: float = 4.0  # cost of exchanged coordinates
    no_place: float = 5.0  # cost of a missing place
    twin_prior: float = 0.5  # the same for two rows of one source
    twin_scale_s: float = 0.5
    twin_scale_km: float = 4.0
    sharpness: float = 0.4  # value per unit of log-odds
    least: float = -2.0  # pairs of less log-odds are not grounded
    transitivity: float = 4.0  # weight of the hinge
    exclusivity: float = 8.0  # the same; above 2 x (0.5 + sharpness x prior) it binds
    rho: float = 1.0
    tolerance: float = 1e-4  # of both residuals
    steps: int = 8  # between two looks at the residuals
    accept: float = 0.5


def _usable(lat: Column, lon: Column) -> Column:
    ok = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon) & F.abs(lat).between(0, 90) & F.abs(lon).between(0, 180)
    return ok & ~((lat == 0) & (lon == 0))


def _views(events: DataFrame) -> DataFrame:
    """Each event as recorded, and as it would be without one of the slips that bulletins have."""
    e = events.withColumn("placed", _usable(F.col("lat"), F.col("lon")))
    here = lambda lat, lon, shift, cost: F.struct(
        F.col(lat).alias("lat"), lon.alias("lon"), (F.col("us") + shift).alias("us"), F.lit(float(cost)).alias("slip")
    )
    r = Rules()
    minute = 60_000_000
    views = F.array(
        here("lat", F.col("lon"), 0, 0),
        here("lat", F.col("lon"), minute, r.minute_slip),
        here("lat", F.col("lon"), -minute, r.minute_slip),
        here("lat", -F.col("lon"), 0, r.sign_slip),
        here("lon", F.col("lat"), 0, r.swap),
    )
    return e.where("placed").select("id", "source", F.explode(views).alias("v")).select("id", "source", "v.*")


def _reach(rules: Rules) -> tuple[int, int, float]:
    """The most microseconds, those without a place, and degrees at which log-odds can be above rules.least."""
    most = rules.prior - rules.least
    us = lambda odds: round((max(odds, 0.0) * rules.scale_s + OFFSET_S) * 1e6)
    km = max(most * rules.scale_km, (rules.twin_prior - rules.least) * rules.twin_scale_km)
    return max(us(most), round(rules.max_s * 1e6)), us(most - rules.no_place), km / KM_PER_DEGREE * 1.0001


def _touched(at: Column, reach: Column | float, width: Column | float) -> Column:
    return F.sequence(F.floor((at - reach) / width), F.floor((at + reach) / width))


def _lon_reach(strip: Column, degrees: float) -> Column:
    """Degrees of longitude that the reach spans at most from a latitude strip of twice its height; 180 near a pole."""
    far = F.least(F.greatest(F.abs(strip * (2 * degrees)), F.abs((strip + 1) * (2 * degrees))), F.lit(90.0))
    share = math.sin(math.radians(degrees)) / F.cos(F.radians(far))
    return F.when((F.cos(F.radians(far)) > 1e-9) & (share < 1), F.degrees(F.asin(F.least(share, F.lit(1.0)))) * 1.0001).otherwise(180.0)


def _turned(lon: Column) -> Column:
    return F.pmod(lon + 180.0, F.lit(360.0))


def candidate_pairs(events: DataFrame, rules: Rules) -> DataFrame:
    """(a, b, source_a, source_b, dt, km, slip), a < b: rows near in time and place under some view.

    Blocking keys are a time bucket, a latitude strip and a longitude cell of the strip, each at least
    twice as wide as the rules reach, across the 180th meridian and the poles; a row is sent
    to those that its reach touches. Rows without a usable place are met by time alone.
    """
    reach_us, blind_us, degrees = _reach(rules)
    strip = lambda lat: F.floor(lat / (2 * degrees))
    cells = F.greatest(F.floor(360.0 / (2 * _lon_reach(F.col("y"), degrees))), F.lit(1))
    left = _views(events).where(F.abs("lat") <= 90).select(
        F.col("id").alias("a"), F.col("source").alias("source_a"), F.col("us").alias("us_a"), F.col("lat").alias("lat_a"),
        F.col("lon").alias("lon_a"), "slip", F.floor(F.col("us") / (2 * reach_us)).alias("t"), strip(F.col("lat")).alias("y"),
    )
    left = left.withColumn("n", cells).withColumn("x", F.pmod(F.floor(_turned(F.col("lon_a")) * F.col("n") / 360.0), F.col("n"))).drop("n")
    placed = events.where(_usable(F.col("lat"), F.col("lon")))
    right = placed.select(
        F.col("id").alias("b"), F.col("source").alias("source_b"), F.col("us").alias("us_b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"),
    )
    right = right.withColumn("y", F.explode(_touched(F.col("lat_b"), degrees, 2 * degrees))).withColumn("n", cells)
    around = _touched(_turned(F.col("lon_b")), _lon_reach(F.col("y"), degrees), 360.0 / F.col("n"))
    around = F.array_distinct(F.transform(around, lambda c: F.pmod(c, F.col("n"))))
    right = right.withColumn("x", F.explode(around)).drop("n")
    right = right.withColumn("t", F.explode(_touched(F.col("us_b"), reach_us, 2 * reach_us)))
    met = left.join(right, ["t", "y", "x"]).where((F.col("a") != F.col("b")) & ((F.col("slip") > 0) | (F.col("a") < F.col("b"))))
    km = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    dt = (F.col("us_a") - F.col("us_b")) / 1e6
    near = met.select("a", "b", "source_a", "source_b", "slip", dt.alias("dt"), km.alias("km"))
    # rows without a place: narrower time buckets, met with all rows of the bucket
    lost = events.where(~F.coalesce(_usable(F.col("lat"), F.col("lon")), F.lit(False)))
    one = lost.select(
        F.col("id").alias("a"), F.col("source").alias("source_a"), F.col("us").alias("us_a"),
        F.explode(_touched(F.col("us"), blind_us, 2 * blind_us)).alias("t"),
    )
    other = events.select(
        F.col("id").alias("b"), F.col("source").alias("source_b"), F.col("us").alias("us_b"), F.floor(F.col("us") / (2 * blind_us)).alias("t")
    )
    blind = one.join(other, "t").where(F.col("a") != F.col("b")).select(
        "a", "b", "source_a", "source_b", F.lit(float(rules.no_place)).alias("slip"), dt.alias("dt"), F.lit(0.0).alias("km")
    )
    both = near.unionByName(blind).where(F.abs("dt") <= reach_us / 1e6)
    turned = F.col("a") > F.col("b")
    return both.select(
        F.least("a", "b").alias("a"),
        F.greatest("a", "b").alias("b"),
        F.when(turned, F.col("source_b")).otherwise(F.col("source_a")).alias("source_a"),
        F.when(turned, F.col("source_a")).otherwise(F.col("source_b")).alias("source_b"),
        F.when(turned, -F.col("dt")).otherwise(F.col("dt")).alias("dt"),
        "km",
        "slip",
    )


def source_offsets(pairs: DataFrame) -> DataFrame:
    """(source_a, source_b, offset): the usual time difference of two sources (truncation, habits)."""
    plain = pairs.where((F.col("slip") == 0) & (F.col("source_a") != F.col("source_b")) & (F.abs("dt") <= OFFSET_S) & (F.col("km") <= 10))
    return plain.groupBy("source_a", "source_b").agg(F.percentile_approx("dt", 0.5, 1000).alias("offset"))


def grounded(pairs: DataFrame, rules: Rules) -> DataFrame:
    """(pair, a, b, source_a, source_b, twin, target): the pairs worth a truth value, with the value the similarity rules alone ask for."""
    same = F.col("source_a") == F.col("source_b")
    lag = F.abs(F.col("dt") - F.coalesce("offset", F.lit(0.0)))
    apart = F.when(same, F.abs("dt") / rules.twin_scale_s + F.col("km") / rules.twin_scale_km).otherwise(
        lag / rules.scale_s + F.col("km") / rules.scale_km
    )
    odds = F.when(same, F.lit(rules.twin_prior)).otherwise(F.lit(rules.prior)) - apart - F.col("slip")
    scored = pairs.join(source_offsets(pairs), ["source_a", "source_b"], "left").withColumn("odds", odds)
    best = scored.where(F.col("odds") > rules.least).groupBy("a", "b").agg(F.max("odds").alias("odds"), F.first("source_a").alias("source_a"), F.first("source_b").alias("source_b"))
    twin = F.col("source_a") == F.col("source_b")
    number = F.monotonically_increasing_id().alias("pair")  # of the row, once the table is written
    return best.select(number, "a", "b", "source_a", "source_b", twin.alias("twin"), (0.5 + rules.sharpness * F.col("odds")).alias("target"))


def _clipped(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def broken_rules(values: DataFrame, rules: Rules) -> DataFrame:
    """(hub, e1, e2, weight, terms): what the values break over each row (hub) that two true pairs share; terms are pairs with a sign.

    values: pair, a, b, source_a, source_b, target, value. Ends in one source that are no twins by
    their own target exclude each other; all others are transitive: the third pair must not be too false.
    """
    seen = values.where(F.col("value") > 0.001)
    ends = seen.select(F.col("a").alias("hub"), F.col("b").alias("end"), F.col("source_b").alias("source"), "pair", "value").unionByName(
        seen.select(F.col("b").alias("hub"), F.col("a").alias("end"), F.col("source_a").alias("source"), "pair", "value")
    )
    one = ends.select("hub", F.col("end").alias("e1"), F.col("source").alias("s1"), F.col("pair").alias("p1"), F.col("value").alias("v1"))
    two = ends.select("hub", F.col("end").alias("e2"), F.col("source").alias("s2"), F.col("pair").alias("p2"), F.col("value").alias("v2"))
    met = one.join(two, "hub").where((F.col("e1") < F.col("e2")) & (F.col("v1") + F.col("v2") > 1.001))
    third = values.select(F.col("a").alias("e1"), F.col("b").alias("e2"), F.col("pair").alias("p3"), F.col("value").alias("v3"), F.col("target").alias("t3"))
    met = met.join(third, ["e1", "e2"], "left")
    apart = (F.col("s1") == F.col("s2")) & (F.coalesce("t3", F.lit(0.0)) < rules.accept)
    met = met.withColumn("apart", apart).withColumn("p3", F.when(~apart, F.col("p3"))).withColumn("v3", F.when(~apart, F.col("v3"))).where(F.col("v1") + F.col("v2") - F.coalesce("v3", F.lit(0.0)) > 1.001)
    terms = F.filter(
        F.array(
            F.struct(F.col("p1").alias("pair"), F.lit(1.0).alias("sign")),
            F.struct(F.col("p2").alias("pair"), F.lit(1.0).alias("sign")),
            F.struct(F.col("p3").alias("pair"), F.lit(-1.0).alias("sign")),
        ),
        lambda t: t["pair"].isNotNull(),
    )
    weight = F.when(F.col("apart"), rules.exclusivity).otherwise(rules.transitivity).alias("weight")
    return met.select("hub", "e1", "e2", weight, terms.alias("terms"))


def _solve_spread(copies: DataFrame, rules: Rules) -> DataFrame:
    """Alternating directions over (rule, pair, sign, weight, target, part, x, u) by window sums, for parts of any size."""
    by_pair, by_rule = Window.partitionBy("pair"), Window.partitionBy("rule")
    columns = copies.columns
    while True:
        for _ in range(rules.steps):
            total, n = F.sum(F.col("x") + F.col("u")).over(by_pair), F.count("*").over(by_pair)
            mean = _clipped((2 * F.col("target") + rules.rho * total) / (2 + rules.rho * n))
            copies = copies.withColumn("z", mean).withColumn("v", F.col("z") - F.col("u"))
            excess = F.sum(F.col("sign") * F.col("v")).over(by_rule) - 1
            pull = F.greatest(F.lit(0.0), F.least(F.col("weight") / rules.rho, excess / F.count("*").over(by_rule)))
            copies = copies.withColumn("old", F.col("x")).withColumn("x", F.col("v") - pull * F.col("sign"))
            copies = copies.withColumn("u", F.col("u") + F.col("x") - F.col("z"))
            copies = copies.select(*columns, F.greatest(F.abs(F.col("x") - F.col("z")), rules.rho * F.abs(F.col("x") - F.col("old"))).alias("residual"))
        copies = cut(copies)
        if not copies.where(F.col("residual") >= rules.tolerance).take(1):
            return copies.select(*columns)
        copies = copies.select(*columns)


def _solve_block(frame: pd.DataFrame, rules: Rules) -> pd.DataFrame:
    """The same over whole parts in numpy; parts are left out of the steps as they settle."""
    done, left = [], frame
    while len(left):
        place = lambda c: np.unique(left[c].to_numpy(), return_inverse=True)[1]  # noqa: B023, E731
        pair, rule, part = place("pair"), place("rule"), place("part")
        sign, target, x, u = (left[c].to_numpy(dtype=float, copy=True) for c in ("sign", "target", "x", "u"))
        n, size = np.bincount(pair)[pair], np.bincount(rule)
        most = left["weight"].to_numpy()[np.unique(rule, return_index=True)[1]] / rules.rho
        for _ in range(10 * rules.steps):
            z = np.clip((2 * target + rules.rho * np.bincount(pair, x + u)[pair]) / (2 + rules.rho * n), 0, 1)
            v, old = z - u, x
            x = v - np.clip((np.bincount(rule, sign * v) - 1) / size, 0, most)[rule] * sign
            u = u + x - z
        residual = np.maximum(np.abs(x - z), rules.rho * np.abs(x - old))
        open_ = (np.bincount(part, residual >= rules.tolerance) > 0)[part]
        left = left.assign(x=x, u=u)
        done.append(left[~open_])
        left = left[open_]
    return pd.concat(done) if done else frame


def solve(copies: DataFrame, rules: Rules) -> DataFrame:
    """(rule, pair, sign, weight, target, part, x, u) with x and u of the solution: alternating directions until the residuals are small."""
    sizes = copies.groupBy("part").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum(F.when(F.col("n") <= BLOCK_ROWS, F.col("n"))).alias("small"), F.max("n").alias("most")).first()
    blocks = max(int(copies.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * (total["small"] or 0) // max(BLOCK_ROWS, 1)))
    large = sizes.where(F.col("n") > BLOCK_ROWS).select("part")
    small = copies.join(large, "part", "left_anti") if (total["most"] or 0) > BLOCK_ROWS else copies
    block = F.pmod(F.xxhash64("part"), F.lit(blocks))
    solved = small.groupBy(block.alias("block")).applyInPandas(lambda frame: _solve_block(frame, rules), small.schema)
    if (total["most"] or 0) > BLOCK_ROWS:
        solved = solved.unionByName(_solve_spread(cut(copies.join(large, "part", "left_semi")), rules))
    return cut(solved)


def exclusive(values: DataFrame, rules: Rules) -> DataFrame:
    """The pairs of different sources that hold, the surest first: a row's partners in one source are one row or twins.

    Values at half, where the hinges leave equal claims, are told apart by target, then by id.
    """
    twins = staged(values.where(F.col("twin") & (F.col("target") >= rules.accept)).select(F.col("a").alias("e1"), F.col("b").alias("e2")), "twins")
    twins = twins.unionByName(twins.select(F.col("e1").alias("e2"), F.col("e2").alias("e1")))
    sure = staged(values.where(~F.col("twin") & (F.col("value") >= rules.accept - 10 * rules.tolerance)), "sure")
    order = F.struct(-F.round("value", 2), -F.col("target"), "a", "b").alias("order")  # the values are as near as the tolerance
    ends = sure.select(F.col("a").alias("hub"), F.col("source_b").alias("in"), F.col("b").alias("end"), "pair", order).unionByName(
        sure.select(F.col("b").alias("hub"), F.col("source_a").alias("in"), F.col("a").alias("end"), "pair", order)
    )
    side = lambda n: ends.select("hub", "in", F.col("end").alias("e" + n), F.col("pair").alias("p" + n), F.col("order").alias("o" + n))
    clash = side("1").join(side("2"), ["hub", "in"]).where(F.col("o1") < F.col("o2")).join(twins, ["e1", "e2"], "left_anti")
    left = cut(clash.select(F.col("p1").alias("better"), F.col("p2").alias("worse")).distinct())
    lost = None
    while left.take(1):  # pairs that no undecided pair is better than stay, and shut out what they clash with
        tops = left.select(F.col("better").alias("pair")).distinct().join(left.select(F.col("worse").alias("pair")), "pair", "left_anti")
        out = cut(left.join(tops.withColumnRenamed("pair", "better"), "better", "left_semi").select(F.col("worse").alias("pair")).distinct())
        lost = out if lost is None else lost.unionByName(out)
        gone = out.withColumnRenamed("pair", "worse")
        left = left.join(gone, "worse", "left_anti").join(gone.withColumnRenamed("worse", "better"), "better", "left_anti")
        left = cut(left)
    return sure if lost is None else sure.join(lost, "pair", "left_anti")


def link(events: DataFrame, rules: Rules | None = None) -> DataFrame:
    """(a, b, confidence), a < b: rows of different sources that report the same earthquake.

    events: id (bigint), source, us (microseconds), lat, lon. Rows with a null id, source or time match
    nothing; rows without a usable place match by time alone, at a cost; repeated rows count
    once. Of a row's pairs into one source the surest is kept, and another one only if the two
    partners are twins by their own times and places.
    """
    rules = rules or Rules()
    clean = events.where(F.col("id").isNotNull() & F.col("source").isNotNull() & F.col("us").isNotNull())
    clean = staged(clean.select("id", "source", "us", "lat", "lon").distinct(), "events")
    pairs = staged(candidate_pairs(clean, rules), "pairs")
    ground = staged(grounded(pairs, rules), "ground")
    parts = connected_groups(ground.select(F.col("a").alias("u"), F.col("b").alias("v")))
    ground = staged(ground.join(parts.select(F.col("v").alias("a"), F.col("group").alias("part")), "a"), "parted")
    values = ground.withColumn("value", _clipped(F.col("target")))
    copies: DataFrame | None = None
    known: DataFrame | None = None
    for turn in itertools.count():
        broken = broken_rules(values, rules)
        if known is not None:
            broken = broken.join(known, ["hub", "e1", "e2"], "left_anti")
        # numbered apart from the rules of earlier turns, so that a rule is one number
        broken = staged(broken.withColumn("rule", F.monotonically_increasing_id() + (turn << 54)), "broken")
        if not broken.take(1):
            break
        known = broken.select("hub", "e1", "e2") if known is None else known.unionByName(broken.select("hub", "e1", "e2"))
        terms = broken.select("rule", "weight", F.explode("terms").alias("t")).select("rule", "weight", "t.pair", "t.sign")
        fresh = terms.join(values.select("pair", "target", "part", "value"), "pair")
        fresh = fresh.select("rule", "pair", "sign", "weight", "target", "part", F.col("value").alias("x"), F.lit(0.0).alias("u"))
        copies = solve(fresh if copies is None else copies.unionByName(fresh), rules)
        mean = _clipped((2 * F.first("target") + rules.rho * F.sum(F.col("x") + F.col("u"))) / (2 + rules.rho * F.count("*")))
        settled = copies.groupBy("pair").agg(mean.alias("settled"))
        values = ground.join(settled, "pair", "left").select(
            *ground.columns, F.coalesce("settled", _clipped(F.col("target"))).alias("value")
        )
        values = staged(values, "values")
    return exclusive(values, rules).select("a", "b", F.greatest("value", F.lit(rules.accept)).alias("confidence"))


def p3_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_uid_a, event_uid_b, confidence): the matching pairs, each with its confidence."""
    events = table(spark, sf_dir, "catalog_event").select(
        F.col("event_uid").alias("id"), "source", F.unix_micros("event_dt").alias("us"), "lat", "lon"
    )
    return link(events).select(F.col("a").alias("event_uid_a"), F.col("b").alias("event_uid_b"), "confidence")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_links(spark, sf_dir).drop("confidence")


def p3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(events, one_source, turned, repeated, unsure): what the pairs must keep to; all but the first are 0.

    one_source counts pairs within a source, turned those with a >= b, repeated pairs that come
    twice, unsure those whose confidence is not between a half and one.
    """
    events = table(spark, sf_dir, "catalog_event").select("event_uid", "source").distinct()
    links = staged(p3_links(spark, sf_dir), "links")
    side = lambda n: events.select(F.col("event_uid").alias(f"event_uid_{n}"), F.col("source").alias(f"source_{n}"))
    told = links.join(side("a"), "event_uid_a").join(side("b"), "event_uid_b")
    count = lambda c: F.count(F.when(c, 1))
    kept = told.agg(
        count(F.col("source_a") == F.col("source_b")).alias("one_source"),
        count(F.col("event_uid_a") >= F.col("event_uid_b")).alias("turned"),
        (F.count("*") - F.count_distinct("event_uid_a", "event_uid_b")).alias("repeated"),
        count(~F.coalesce(F.col("confidence").between(0.5, 1.0), F.lit(False))).alias("unsure"),
    )
    return events.agg(F.count_distinct("event_uid").alias("events")).join(kept)  # one row each

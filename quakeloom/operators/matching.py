"""Matching two catalogs one to one, finding doubles, and fusing catalogs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quakeloom.functions.geo import chord_km, haversine_km
from quakeloom.operators.bands import band_join
from quakeloom.operators.regions import KM_PER_DEGREE, own_cell, touched_cells
from quakeloom.session import cut, staged


@dataclass(frozen=True)
class Thresholds:
    """Of time (s), distance (km) and magnitude; strict ones decide first, loose ones bound the candidates."""

    strict_s: float = 2.0
    loose_s: float = 30.0
    strict_km: float = 15.0
    loose_km: float = 50.0
    magnitude: float = 1.5
    time_weight: float = 0.95
    double_s: float = 1.0
    double_km: float = 50.0
    merge_s: float = 0.15
    merge_km: float = 10.0


def candidates(one: DataFrame, two: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """(id1, id2, dt_s, km, mag_diff, is_ml, strict, cost) of pairs nearer than the loose thresholds.

    one, two: id, us, lat, lon and, if known, mag, mag_type, mag_author. Time is bounded
    strictly, distance inclusively. The magnitude rule binds only pairs of ML of LDG or OMP;
    without a magnitude such a pair is not strict.
    """
    t = t or Thresholds()

    def side(df: DataFrame, n: str) -> DataFrame:
        has = set(df.columns)
        extra = [(F.col(c) if c in has else F.lit(None)).cast(k).alias(c + n) for c, k in (("mag", "double"), ("mag_type", "string"), ("mag_author", "string"))]
        return df.select(F.col("id").alias("id" + n), F.col("us").alias("us" + n), F.col("lat").alias("lat" + n), F.col("lon").alias("lon" + n), *extra)

    loose_us = round(t.loose_s * 1e6)
    degrees = t.loose_km / KM_PER_DEGREE * 1.0001
    placed = lambda df, n: df.where(F.abs("lat" + n).between(0, 90) & (F.abs("lon" + n) < float("inf")))
    cells = touched_cells(F.col("lat1"), F.col("lon1"), degrees), own_cell(F.col("lat2"), F.col("lon2"), degrees)
    near = band_join(placed(side(one, "1"), "1"), placed(side(two, "2"), "2"), "us1", "us2", -loose_us + 1, loose_us - 1, cells)
    km = haversine_km(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2"))
    near = near.withColumn("km", km).where(F.col("km") <= t.loose_km)
    ml = lambda n: F.coalesce((F.upper("mag_type" + n) == "ML") & F.col("mag_author" + n).isin("LDG", "OMP"), F.lit(False))
    dt = F.abs(F.col("us1") - F.col("us2")) / 1e6
    diff = F.abs(F.col("mag1") - F.col("mag2"))
    is_ml = ml("1") & ml("2")
    near = near.select("id1", "id2", dt.alias("dt_s"), "km", diff.alias("mag_diff"), is_ml.alias("is_ml"))
    strict = (F.col("dt_s") <= t.strict_s) & (F.col("km") <= t.strict_km) & (~F.col("is_ml") | F.coalesce(F.col("mag_diff") <= t.magnitude, F.lit(False)))
    cost = t.time_weight * (F.col("dt_s") / t.loose_s) + (1 - t.time_weight) * (F.col("km") / t.loose_km)
    return near.withColumn("strict", strict).withColumn("cost", cost)


def cheapest_first(pairs: DataFrame) -> DataFrame:
    """One-to-one pairs as if taken in the order of (cost, id1, id2).

    Under a total order that is the same as taking, again and again, all pairs that come
    first for both of their ends; each round is two aggregations and two anti joins.
    """
    order = F.struct("cost", "id1", "id2")
    left = cut(pairs)
    taken: DataFrame | None = None
    while left.take(1):
        first1 = left.groupBy("id1").agg(F.min(order).alias("m")).select("m.*")
        first2 = left.groupBy("id2").agg(F.min(order).alias("m")).select("m.id1", "m.id2")
        won = cut(left.join(first1.select("id1", "id2"), ["id1", "id2"], "left_semi").join(first2, ["id1", "id2"], "left_semi"))
        taken = won if taken is None else taken.unionByName(won)
        left = left.join(won.select("id1"), "id1", "left_anti").join(won.select("id2"), "id2", "left_anti")
        left = cut(left)
    return pairs.limit(0) if taken is None else taken


def two_phase(pairs: DataFrame) -> DataFrame:
    """pairs that are matched, with phase strict or loose: strict pairs first, loose ones among the ends left free."""
    pairs = staged(pairs, "candidates")
    strict = cheapest_first(pairs.where("strict")).withColumn("phase", F.lit("strict"))
    free = pairs.where(~F.col("strict")).join(strict.select("id1"), "id1", "left_anti").join(strict.select("id2"), "id2", "left_anti")
    return strict.unionByName(cheapest_first(free).withColumn("phase", F.lit("loose")))


def shared_picks(pairs: DataFrame, picks: DataFrame) -> DataFrame:
    """(id1, id2, n): stations and phases read in both events, S left out, at most 1 s from the pair's first reading.

    picks: event_uid, pick_seq, code, phase, us. Readings of the first event come before those of the second.
    """
    p = picks.where(~F.col("phase").startswith("S") & F.col("us").isNotNull()).select("event_uid", "pick_seq", "code", "phase", "us")
    both = pairs.select("id1", "id2", F.explode(F.array(F.struct(F.lit(1).alias("side"), F.col("id1").alias("event_uid")), F.struct(F.lit(2).alias("side"), F.col("id2").alias("event_uid")))).alias("e"))
    read = both.select("id1", "id2", "e.side", "e.event_uid").join(p, "event_uid")
    first = read.groupBy("id1", "id2", "code", "phase").agg(
        F.min(F.struct("side", "pick_seq", "us")).alias("f"), F.sort_array(F.collect_list("us")).alias("all")
    )
    close = F.size(F.filter("all", lambda u: F.abs(u - F.col("f.us")) <= 1_000_000))
    return first.where(close > 1).groupBy("id1", "id2").agg(F.count("*").alias("n"))


def double_pairs(events: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """(id1, id2, dt_s, km), id1 earlier: rows of one source within the thresholds, depth included in the distance.

    A row without position is in no pair; without depth it counts as at the surface.
    """
    t = t or Thresholds()
    side = lambda n: events.select(*[F.col(c).alias(c + n) for c in ("id", "source", "us", "lat", "lon", "dep")])
    us = round(t.double_s * 1e6)
    near = band_join(side("1"), side("2"), "us1", "us2", 0, us, (F.array("source1"), F.col("source2")))
    same = ((F.col("us1") < F.col("us2")) | (F.col("id1") < F.col("id2"))) & (F.col("id1") != F.col("id2"))
    dep = lambda n: F.coalesce("dep" + n, F.lit(0.0))
    km = chord_km(F.col("lat1"), F.col("lon1"), dep("1"), F.col("lat2"), F.col("lon2"), dep("2"))
    return near.where(same).select("id1", "id2", ((F.col("us2") - F.col("us1")) / 1e6).alias("dt_s"), km.alias("km")).where(F.col("km") <= t.double_km)


def linked_groups(pairs: DataFrame) -> DataFrame:
    """(id, group_id): the least id that each id of the pairs is linked with, by passing on labels until none changes."""
    edges = staged(pairs.select("id1", "id2").unionByName(pairs.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"))).distinct(), "links")
    labels = cut(edges.groupBy(F.col("id1").alias("id")).agg(F.least(F.first("id1"), F.min("id2")).alias("group_id")))
    while True:
        offered = edges.join(labels.select(F.col("id").alias("id2"), F.col("group_id").alias("other")), "id2").groupBy(F.col("id1").alias("id")).agg(F.min("other").alias("other"))
        # also the label of the own label: halves the length of chains
        up = labels.select(F.col("id").alias("group_id"), F.col("group_id").alias("upper"))
        new = labels.join(offered, "id").join(up, "group_id", "left")
        new = cut(new.select("id", F.least("group_id", "other", "upper").alias("group_id"), (F.least("group_id", "other", "upper") < F.col("group_id")).alias("moved")))
        labels = new.drop("moved")
        if not new.where("moved").take(1):
            return labels


def double_groups(pairs: DataFrame, t: Thresholds | None = None) -> DataFrame:
    """(id, group_id, members, action): merge for two events very near each other, else review."""
    t = t or Thresholds()
    groups = linked_groups(pairs)
    sizes = groups.groupBy("group_id").agg(F.count("*").alias("members"))
    close = pairs.join(groups.withColumnRenamed("id", "id1"), "id1").groupBy("group_id").agg(F.max((F.col("dt_s") <= t.merge_s) & (F.col("km") <= t.merge_km)).alias("close"))
    action = F.when((F.col("members") == 2) & F.col("close"), "merge").otherwise("review")
    return groups.join(sizes, "group_id").join(close, "group_id").select("id", "group_id", "members", action.alias("action"))


def time_unique(one: DataFrame, two: DataFrame, tolerance_us: int) -> DataFrame:
    """(id1, id2): rows of the first catalog in the order of seq, each with the only row of the second within the tolerance that is still free.

    one: id, us, seq. two: id, us. A row with no free one, or with several, takes none.
    """
    left, right = one.select(F.col("id").alias("id1"), "seq", F.col("us").alias("us1")), two.select(F.col("id").alias("id2"), F.col("us").alias("us2"))
    near = band_join(left, right, "us1", "us2", -tolerance_us, tolerance_us)
    gap = F.abs(F.col("us1") - F.col("us2")) / 1e6
    return first_come(near.select("id1", "seq", "id2", F.lit(0.0).alias("km"), gap.alias("dt_s")), only_choice=True)


def fused(catalogs: list[DataFrame], picks: DataFrame | None = None, t: Thresholds | None = None) -> DataFrame:
    """The catalogs folded into one, in the given order: id, us, lats, lons, deps, mags, members.

    Each catalog: id, us, lat, lon, dep and, if known, mag, mag_type, mag_author. An event
    keeps the time of the first catalog that has it; its statistics have one slot for each
    catalog, null where the catalog lacks the event. Matching reads the first slots. Loose matches count only if the events share a
    reading (see shared_picks); without picks they do not count.
    """
    stats = ("lat", "lon", "dep", "mag")

    def known(df: DataFrame) -> DataFrame:
        kinds = [(c, "double") for c in stats] + [("mag_type", "string"), ("mag_author", "string")]
        return df.select("id", "us", *[(F.col(c) if c in df.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds])

    main = known(catalogs[0]).select("id", "us", "mag_type", "mag_author", *[F.array(c).alias(c + "s") for c in stats], F.array("id").alias("members"))
    main = cut(main)
    for k, catalog in enumerate(catalogs[1:], 1):
        other = cut(known(catalog))
        first = lambda c: F.try_element_at(F.filter(c + "s", lambda v: v.isNotNull()), F.lit(1)).alias(c)
        seen = main.select("id", "us", first("lat"), first("lon"), F.get("mags", F.lit(0)).alias("mag"), "mag_type", "mag_author")
        found = two_phase(candidates(seen, other, t))
        sure = found.where("phase = 'strict'").select("id1", "id2", "is_ml")
        if picks is not None:
            loose = found.where("phase = 'loose'").select("id1", "id2", "is_ml")
            ends = loose.join(main.select(F.col("id").alias("id1"), "members"), "id1").select("id1", "id2", F.explode("members").alias("member"))
            read = ends.select("member", "id2").distinct()
            told = shared_picks(read.select(F.col("member").alias("id1"), "id2"), picks).select(F.col("id1").alias("member"), "id2")
            proven = ends.join(told, ["member", "id2"]).select("id1", "id2").distinct()
            sure = sure.unionByName(loose.join(proven, ["id1", "id2"], "left_semi"))
        sure = cut(sure)
        joined = main.join(sure.withColumnRenamed("id1", "id"), "id", "left").join(
            other.select(F.col("id").alias("id2"), *[F.col(c).alias("_" + c) for c in stats]), "id2", "left"
        )
        slot = {c: F.col("_" + c) for c in ("lat", "lon", "dep")} | {"mag": F.when(F.col("is_ml"), F.col("_mag"))}
        kept = joined.select(
            "id", "us", "mag_type", "mag_author", *[F.concat(c + "s", F.array(slot[c])).alias(c + "s") for c in stats],
            F.when(F.col("id2").isNull(), F.col("members")).otherwise(F.concat("members", F.array("id2"))).alias("members"),
        )
        new = other.join(sure.select(F.col("id2").alias("id")), "id", "left_anti")
        pad = F.array_repeat(F.lit(None).cast("double"), k)
        added = new.select("id", "us", "mag_type", "mag_author", *[F.concat(pad, F.array(c)).alias(c + "s") for c in stats], F.array("id").alias("members"))
        main = cut(kept.unionByName(added))
    return main


def first_come(pairs: DataFrame, only_choice: bool = False) -> DataFrame:
    """(id1, id2) as if the rows of the first catalog chose in the order of seq among what is still free.

    pairs: id1, seq (one for each id1, all different), id2, km, dt_s. A row takes its free candidate of least
    (km, dt_s, id2); with only_choice it takes one only if exactly one is free, else none. In
    each round those rows choose that no undecided earlier row can interfere with, so that the result is that of the order.
    """
    left = cut(pairs.select("id1", "seq", "id2", "km", "dt_s").distinct())
    taken: DataFrame | None = None
    while left.take(1):
        first = left.groupBy("id2").agg(F.min("seq").alias("first"))
        best = left.groupBy("id1").agg(
            F.min(F.struct("km", "dt_s", "id2")).alias("b"), F.count("*").alias("n"), F.first("seq").alias("own")
        )
        if only_choice:  # decided once it is the first of all its candidates
            asked = left.join(first, "id2").groupBy("id1").agg(F.min(F.col("seq") == F.col("first")).alias("free"))
            decided = cut(best.join(asked.where("free"), "id1").select("id1", "b.id2", "n"))
            won = decided.where("n = 1").select("id1", "id2")
        else:  # decided once it is the first of its best candidate
            wish = best.select("id1", "own", "b.id2")
            decided = cut(wish.join(first, "id2").where(F.col("own") == F.col("first")).select("id1", "id2"))
            won = decided
        taken = won if taken is None else taken.unionByName(won)
        left = cut(left.join(decided.select("id1"), "id1", "left_anti").join(won.select("id2"), "id2", "left_anti"))
    return pairs.select("id1", "id2").limit(0) if taken is None else taken

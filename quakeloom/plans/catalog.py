"""Queries on events: distances, areas, candidates, doubles, fusion and statistics, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions import geo, seismic
from quakeloom.functions.seismic import fixed
from quakeloom.operators import matching, statistics
from quakeloom.operators.bands import numbered
from quakeloom.operators.regions import box_edges, containing_regions
from quakeloom.plans import picks
from quakeloom.session import staged, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return table(spark, sf_dir, "catalog_event").select(
        F.col("event_uid").alias("id"), "source", F.unix_micros("event_dt").alias("us"), "lat", "lon", *columns
    )


def _events_with_mags(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Events with one magnitude each: an ML of LDG or OMP before others, then the first given."""
    m = picks.mags(spark, sf_dir)
    local = (F.col("mag_type") == "ml") & F.col("mag_author").isin("LDG", "OMP")
    order = F.struct(F.when(local, 0).otherwise(1), "mag_id", "mag", F.upper("mag_type").alias("mag_type"), "mag_author")
    best = m.groupBy(F.col("event_uid").alias("id")).agg(F.min(order).alias("b")).select("id", "b.mag", "b.mag_type", "b.mag_author")
    return _events(spark, sf_dir, *columns).join(best, "id", "left")


def _placed(df: DataFrame) -> DataFrame:
    return df.where(F.col("us").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())


_FIX = "floor(({}) * 1e6 + 5e-1) / 1e6"
_HAV = (
    "2e0 * 6371e0 * asin(sqrt(least(1e0, sin(radians({b}.lat - {a}.lat) / 2e0) * sin(radians({b}.lat - {a}.lat) / 2e0)"
    " + cos(radians({a}.lat)) * cos(radians({b}.lat)) * sin(radians({b}.lon - {a}.lon) / 2e0) * sin(radians({b}.lon - {a}.lon) / 2e0))))"
)
_E = "SELECT event_uid AS id, source, epoch_us(event_dt) AS us, lat, lon, dep FROM catalog_event"
_EM = f"""{picks.MAGS_SQL}, em AS (SELECT event_uid AS id, mag, upper(mag_type) AS mag_type, mag_author FROM m
  QUALIFY row_number() OVER (PARTITION BY event_uid ORDER BY CASE WHEN mag_type = 'ml' AND mag_author IN ('LDG', 'OMP') THEN 0 ELSE 1 END, mag_id, mag) = 1),
e AS (SELECT * FROM ({_E}) LEFT JOIN em USING (id))"""
_IS_ML = "coalesce(a.mag_type = 'ML' AND a.mag_author IN ('LDG', 'OMP') AND b.mag_type = 'ML' AND b.mag_author IN ('LDG', 'OMP'), FALSE)"


def _candidates_sql(one: str, two: str) -> str:
    """Pairs of two tables (id, us, lat, lon, mag, mag_type, mag_author) with cost, is_ml and strict."""
    return f"""SELECT *, 9.5e-1 * (dt_s / 3e1) + 5e-2 * (km / 5e1) AS cost, dt_s <= 2e0 AND km <= 1.5e1 AND (NOT is_ml OR coalesce(mag_diff <= 1.5e0, FALSE)) AS strict
  FROM (SELECT a.id AS id1, b.id AS id2, abs(a.us - b.us) / 1e6 AS dt_s, {_HAV.format(a="a", b="b")} AS km, abs(a.mag - b.mag) AS mag_diff, {_IS_ML} AS is_ml
    FROM {one} a JOIN {two} b ON abs(a.us - b.us) < 30000000) WHERE km <= 5e1"""


def _greedy_sql(pairs: str, n: str) -> str:
    """taken{n}: the pairs taken one by one, strict ones first, then by cost and ids, with both ends free."""
    return f"""n{n} AS (SELECT *, row_number() OVER (ORDER BY strict DESC, cost, id1, id2) AS k FROM {pairs}),
g{n} AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS u1, CAST([] AS BIGINT[]) AS u2, FALSE AS ok UNION ALL
  SELECT k, CASE WHEN ok THEN list_append(u1, id1) ELSE u1 END, CASE WHEN ok THEN list_append(u2, id2) ELSE u2 END, ok
  FROM (SELECT n.k, n.id1, n.id2, g.u1, g.u2, NOT list_contains(g.u1, n.id1) AND NOT list_contains(g.u2, n.id2) AS ok FROM g{n} g JOIN n{n} n ON n.k = g.k + 1)),
taken{n} AS (SELECT n.* FROM n{n} n JOIN g{n} g USING (k) WHERE g.ok)"""


def _in_turn_sql(pairs: str, only: bool) -> str:
    """taken: rows of pairs (id1, seq, id2, km, dt_s) in the order of seq, each with its best, or its only, id2 that is free."""
    pick = "CASE WHEN len(free) = 1 THEN free[1] END" if only else "free[1]"
    return f"""q AS (SELECT id1, list(id2 ORDER BY km, dt_s, id2) AS c, row_number() OVER (ORDER BY min(seq)) AS k FROM {pairs} GROUP BY id1),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS used, CAST(NULL AS BIGINT) AS id1, CAST(NULL AS BIGINT) AS id2 UNION ALL
  SELECT k, CASE WHEN t IS NULL THEN used ELSE list_append(used, t) END, id1, t
  FROM (SELECT k, used, id1, {pick} AS t FROM (SELECT q.k, g.used, q.id1, list_filter(q.c, lambda x: NOT list_contains(g.used, x)) AS free FROM g JOIN q ON q.k = g.k + 1))),
taken AS (SELECT id1, id2 FROM g WHERE id2 IS NOT NULL)"""


_PAIRS = f"""WITH RECURSIVE {_EM}, one AS (SELECT * FROM e WHERE source = 'LDG'), two AS (SELECT * FROM e WHERE source <> 'LDG'), p AS ({_candidates_sql("one", "two")})
"""
_NEAR = _PAIRS.rstrip() + """, near AS (SELECT p.*, seq FROM p JOIN catalog_event ON event_uid = id1 WHERE dt_s <= 2 AND km <= 15), """


def _two_catalogs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The most used source, and all others as one catalog."""
    e = staged(_events_with_mags(spark, sf_dir), "events")
    return e.where("source = 'LDG'"), e.where("source <> 'LDG'")


@query(_PAIRS + f"""SELECT id1, id2, dt_s, {_FIX.format("km")} AS km, {_FIX.format("cost")} AS cost, is_ml, strict FROM p""")
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of two catalogs within 30 s and 50 km, with cost and whether the strict thresholds hold, that of magnitude included."""
    one, two = _two_catalogs(spark, sf_dir)
    return matching.candidates(one, two).select("id1", "id2", "dt_s", fixed(F.col("km")).alias("km"), fixed(F.col("cost")).alias("cost"), "is_ml", "strict")


@query(_PAIRS.rstrip() + ", " + _greedy_sql("p", "") + f" SELECT id1, id2, CASE WHEN strict THEN 'strict' ELSE 'loose' END AS phase, {_FIX.format('cost')} AS cost FROM taken")
def match_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of two catalogs, cheapest first, strict before loose."""
    one, two = _two_catalogs(spark, sf_dir)
    return matching.two_phase(matching.candidates(one, two)).select("id1", "id2", "phase", fixed(F.col("cost")).alias("cost"))


def _in_file_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _two_catalogs(spark, sf_dir)
    close = matching.candidates(one, two).where("dt_s <= 2 AND km <= 15").select("id1", "id2", "km", "dt_s")
    order = table(spark, sf_dir, "catalog_event").select(F.col("event_uid").alias("id1"), "seq")
    return close.join(order, "id1")


@query(_NEAR + _in_turn_sql("near", False) + " SELECT id1, id2 FROM taken")
def mag_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one source, in file order, with the nearest free event of the others within 2 s and 15 km."""
    return matching.first_come(_in_file_order(spark, sf_dir))


@query(_NEAR + _in_turn_sql("near", True) + " SELECT id1, id2 FROM taken")
def sequential_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one source, in file order, with the others' only free event within 2 s and 15 km."""
    return matching.first_come(_in_file_order(spark, sf_dir), only_choice=True)


_CHORD = "(6371e0 - coalesce({0}.dep, 0e0))"
_XYZ = " + ".join(
    f"pow({_CHORD.format('a')} * {t.format('a')} - {_CHORD.format('b')} * {t.format('b')}, 2)"
    for t in (
        "cos(radians({0}.lat)) * cos(radians({0}.lon))",
        "cos(radians({0}.lat)) * sin(radians({0}.lon))",
        "sin(radians({0}.lat))",
    )
)
_DOUBLES = f"""
WITH RECURSIVE e AS ({_E}), d AS (
  SELECT a.id AS id1, b.id AS id2, (b.us - a.us) / 1e6 AS dt_s, sqrt({_XYZ}) AS km
  FROM e a JOIN e b ON a.source = b.source AND a.id <> b.id AND b.us - a.us BETWEEN 0 AND 1000000 AND (a.us < b.us OR a.id < b.id)),
p AS (SELECT * FROM d WHERE km <= 5e1)
"""
_GROUPS = _DOUBLES + """, links AS (SELECT id1 AS x, id2 AS y FROM p UNION SELECT id2, id1 FROM p),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
g AS (SELECT x AS id, least(x, min(y)) AS group_id FROM reach GROUP BY x),
s AS (SELECT group_id, count(*) AS members FROM g GROUP BY group_id),
c AS (SELECT group_id, max(CASE WHEN dt_s <= 1.5e-1 AND km <= 1e1 THEN 1 ELSE 0 END) AS near FROM p JOIN g ON p.id1 = g.id GROUP BY group_id),
act AS (SELECT g.id, g.group_id, s.members, CASE WHEN s.members = 2 AND c.near = 1 THEN 'merge' ELSE 'review' END AS action
  FROM g JOIN s USING (group_id) JOIN c USING (group_id))
"""


def _doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.double_pairs(_events(spark, sf_dir, "dep"))


@query(_DOUBLES + f"SELECT id1, id2, dt_s, {_FIX.format('km')} AS km FROM p")
def double_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one source within 1 s and 50 km (straight distance, depth included)."""
    return _doubles(spark, sf_dir).withColumn("km", fixed(F.col("km")))


@query(_GROUPS + "SELECT id, group_id, members, action FROM act")
def double_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected groups of doubles, and whether they merge by rule or need a decision."""
    return matching.double_groups(_doubles(spark, sf_dir))


@query(_GROUPS + """, m AS (SELECT a.group_id, p.pick_id, p.event_uid, p.code, substr(p.phase, 1, 1) AS letter, p.pick_seq
  FROM act a JOIN (SELECT DISTINCT pick_id, event_uid, code, phase, pick_seq FROM phase_pick) p ON p.event_uid = a.id WHERE a.action = 'merge')
SELECT group_id, pick_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id, code, letter
  ORDER BY CASE WHEN event_uid = group_id THEN 0 ELSE 1 END, event_uid, pick_seq, pick_id) AS n FROM m) WHERE n = 1""")
def double_merged_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picks of merged doubles: those of the kept event, then what the other adds."""
    from quakeloom.operators.picklists import merged_phases

    groups = matching.double_groups(_doubles(spark, sf_dir)).where("action = 'merge'").select("id", "group_id")
    picks = table(spark, sf_dir, "phase_pick").select("pick_id", "event_uid", "code", "phase", "pick_seq").distinct()
    return merged_phases(groups, picks)


_FIRST = "list_filter({0}, lambda x: x IS NOT NULL)[1]"


def _fold_sql(sources: int) -> str:
    """The fold over so many sources in the order of trust, one step a source; main{k} has the catalogs up to number k."""
    parts = [f"""WITH RECURSIVE {_EM}, {picks.PICKS_SQL},
ranked AS (SELECT source, row_number() OVER (ORDER BY min(trust_rank) NULLS LAST, source NULLS LAST) AS turn FROM e LEFT JOIN source_info USING (source) WHERE us IS NOT NULL GROUP BY source),
ev AS (SELECT e.*, turn FROM e JOIN ranked ON e.source IS NOT DISTINCT FROM ranked.source WHERE us IS NOT NULL),
main1 AS (SELECT id, us, [lat] AS lats, [lon] AS lons, [dep] AS deps, [mag] AS mags, mag_type, mag_author, [id] AS members FROM ev WHERE turn = 1)"""]  # fmt: skip
    for k in range(2, sources + 1):
        old = f"main{k - 1}"
        slots = ", ".join(f"list_append(m.{c}s, o.{c}) AS {c}s" for c in ("lat", "lon", "dep"))
        pad = ", ".join(f"list_append(list_resize(CAST([] AS DOUBLE[]), {k - 1}), o.{c}) AS {c}s" for c in ("lat", "lon", "dep", "mag"))
        parts.append(f"""other{k} AS (SELECT * FROM ev WHERE turn = {k}),
seen{k} AS (SELECT id, us, {_FIRST.format("lats")} AS lat, {_FIRST.format("lons")} AS lon, mags[1] AS mag, mag_type, mag_author FROM {old}),
p{k} AS ({_candidates_sql(f"seen{k}", f"other{k}")}), {_greedy_sql(f"p{k}", str(k))},
loose{k} AS (SELECT id1, id2, unnest(members) AS member FROM taken{k} JOIN {old} ON id = id1 WHERE NOT strict),
r{k} AS (SELECT id1, id2, member, 1 AS side, pick_seq, code, phase, us FROM loose{k} JOIN tp ON event_uid = member WHERE us IS NOT NULL AND phase NOT LIKE 'S%'
  UNION ALL SELECT id1, id2, member, 2, pick_seq, code, phase, us FROM loose{k} JOIN tp ON event_uid = id2 WHERE us IS NOT NULL AND phase NOT LIKE 'S%'),
f{k} AS (SELECT *, first_value(us) OVER (PARTITION BY member, id2, code, phase ORDER BY side, pick_seq, us) AS first_us FROM r{k}),
proven{k} AS (SELECT DISTINCT id1, id2 FROM (SELECT id1, id2 FROM f{k} WHERE abs(us - first_us) <= 1000000 GROUP BY id1, id2, member, code, phase HAVING count(*) > 1)),
sure{k} AS (SELECT id1, id2, is_ml FROM taken{k} t WHERE strict OR EXISTS (SELECT 1 FROM proven{k} v WHERE v.id1 = t.id1 AND v.id2 = t.id2)),
main{k} AS (SELECT m.id, m.us, {slots}, list_append(m.mags, CASE WHEN s.is_ml THEN o.mag END) AS mags, m.mag_type, m.mag_author,
    CASE WHEN o.id IS NULL THEN m.members ELSE list_append(m.members, o.id) END AS members FROM {old} m LEFT JOIN sure{k} s ON s.id1 = m.id LEFT JOIN other{k} o ON o.id = s.id2
  UNION ALL SELECT o.id, o.us, {pad}, o.mag_type, o.mag_author, [o.id] FROM other{k} o WHERE o.id NOT IN (SELECT id2 FROM sure{k}))""")
    mean = "list_avg(list_filter(mags, lambda x: x IS NOT NULL))"
    return ",\n".join(parts) + f""" SELECT id, us, {_FIRST.format("lats")} AS lat, {_FIRST.format("lons")} AS lon, {_FIRST.format("deps")} AS dep, {_FIX.format(mean)} AS mag,
  array_to_string(members, ',') AS members FROM main{sources}"""


@query(_fold_sql(5))
def fuse_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources fused in order of trust, loose matches proven by shared readings; the magnitude is the mean of the known slots."""
    e = staged(_events_with_mags(spark, sf_dir, "dep").where("us IS NOT NULL"), "events")
    ranks = table(spark, sf_dir, "source_info").groupBy("source").agg(F.min("trust_rank").alias("rank"))
    order = e.select("source").distinct().join(ranks, "source", "left").orderBy(F.col("rank").asc_nulls_last(), F.col("source").asc_nulls_last()).collect()
    done = matching.fused([e.where(F.col("source").eqNullSafe(F.lit(r.source))) for r in order], staged(picks.timed_picks(spark, sf_dir), "picks"))
    first = lambda c: F.try_element_at(F.filter(c, lambda v: v.isNotNull()), F.lit(1))
    return done.select(
        "id", "us", first("lats").alias("lat"), first("lons").alias("lon"), first("deps").alias("dep"), fixed(seismic.mean_of(F.col("mags"))).alias("mag"),
        F.array_join("members", ",").alias("members"),
    )


@query(f"""WITH e AS ({_E}) SELECT z.zone_id, e.id FROM e JOIN reloc_zone z
  ON e.lat BETWEEN z.lat_min AND z.lat_max AND e.lon BETWEEN z.lon_min AND z.lon_max""")
def zone_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with every relocation zone that contains them, edges included."""
    return containing_regions(_events(spark, sf_dir), "id", box_edges(table(spark, sf_dir, "reloc_zone"), "zone_id"), "zone_id").select("zone_id", "id")


def _side_sql(line: tuple, side: str) -> str:
    (y1, x1), (y2, x2) = line
    sign = "<" if side == "above" else ">"
    return f"(lon - ({x1:e})) * ({y2 - y1:e}) - (lat - ({y1:e})) * ({x2 - x1:e}) {sign} 0"


_AREA = " AND ".join(_side_sql(*c) for c in geo.AREA_COMMON) + "".join(
    f" AND (source <> '{s}' OR {_side_sql(*c)})" for s, c in geo.AREA_BY_SOURCE.items()
)


@query(f"SELECT id, source FROM ({_E}) WHERE {_AREA}")
def aoi_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events inside the area of interest; the lines depend on the source."""
    e = _events(spark, sf_dir)
    return e.where(geo.in_area(F.col("source"), F.col("lat"), F.col("lon"))).select("id", "source")


@query("SELECT event_uid AS id FROM catalog_event WHERE erh <= 3 AND erv <= 3 AND az_gap <= 300 AND rms <= 5e-1")
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with small errors; an unknown error fails."""
    e = table(spark, sf_dir, "catalog_event")
    return e.where("erh <= 3 AND erv <= 3 AND az_gap <= 300 AND rms <= 0.5").select(F.col("event_uid").alias("id"))


@query("""WITH q AS (SELECT quantile_cont(rms, 9.9e-1) AS q FROM catalog_event WHERE rms IS NOT NULL)
SELECT event_uid AS id FROM catalog_event, q WHERE rms <= q.q + 1e-9""")
def quantile_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose rms is at most its 99 % quantile."""
    e = table(spark, sf_dir, "catalog_event").select(F.col("event_uid").alias("id"), "rms")
    mark = statistics.quantiles(e, "rms", [0.99])
    return e.join(F.broadcast(mark)).where(F.col("rms") <= F.get("q", F.lit(0)) + 1e-9).select("id")  # mark is one row


@query("""WITH q AS (SELECT quantile_cont(erh, 5e-3) AS h0, quantile_cont(erh, 9.95e-1) AS h1, quantile_cont(erv, 5e-3) AS v0, quantile_cont(erv, 9.95e-1) AS v1
  FROM catalog_event WHERE erh IS NOT NULL AND erv IS NOT NULL),
e AS (SELECT erh, erv FROM catalog_event, q WHERE erh BETWEEN h0 - 1e-9 AND h1 + 1e-9 AND erv BETWEEN v0 - 1e-9 AND v1 + 1e-9)
SELECT count(*) AS n, floor(corr(erh, erv) * 1e6 + 5e-1) / 1e6 AS pearson FROM e""")
def central99_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of the horizontal and vertical error over the central 99 % of both."""
    e = table(spark, sf_dir, "catalog_event").select("erh", "erv").dropna()
    inside = statistics.central(e, ["erh", "erv"], 0.005, 0.995)
    return inside.agg(F.count("*").alias("n"), fixed(F.corr("erh", "erv")).alias("pearson"))


@query("""SELECT least(floor(dep / 1e0), 39)::INTEGER AS bin, count(*) AS n FROM catalog_event WHERE dep BETWEEN 0 AND 40 GROUP BY 1""")
def depth_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depths in bins of 1 km from 0 to 40, the last closed."""
    return statistics.histogram(table(spark, sf_dir, "catalog_event"), "dep", 0.0, 40.0, 40)


@query("""SELECT least(floor(az_gap / 7.2e0), 49)::INTEGER AS bx, least(floor(rms / 2e-2), 49)::INTEGER AS by, count(*) AS n
FROM catalog_event WHERE az_gap BETWEEN 0 AND 360 AND rms BETWEEN 0 AND 1 GROUP BY 1, 2""")
def hist2d_gap_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Azimuthal gap against residual in 50 x 50 bins."""
    return statistics.histogram_2d(table(spark, sf_dir, "catalog_event"), "az_gap", "rms", (0.0, 360.0), (0.0, 1.0), 50)


_GRID = """
WITH e AS (SELECT dep, (lat - 4.2e1) * 2e2 AS u, (lon + 2.25e0) * (860 / 5.75e0) AS v FROM catalog_event
  WHERE dep IS NOT NULL AND lat BETWEEN 42 AND 44 AND lon BETWEEN -2.25 AND 3.5),
c AS (SELECT dep, unnest(range(greatest(ceil(u - 4 - 1)::INTEGER, 0), least(floor(u + 4)::INTEGER, 399) + 1)) AS i, v FROM e),
d AS (SELECT dep, i, unnest(range(greatest(ceil(v - 4 - 1)::INTEGER, 0), least(floor(v + 4)::INTEGER, 859) + 1)) AS j FROM c),
g AS (SELECT i::INTEGER AS i, j::INTEGER AS j, count(*) AS n, median(dep) AS median FROM d GROUP BY 1, 2 HAVING count(*) >= 10)
"""


@query(_GRID + f"SELECT i, j, n, {_FIX.format('median')} AS median FROM g")
def depth_grid_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median depth and count in sliding windows over a map of 400 x 860 cells."""
    done = statistics.grid_windows(table(spark, sf_dir, "catalog_event"), "dep")
    return done.select("i", "j", "n", fixed(F.col("median")).alias("median"))


@query(_GRID + f"""SELECT count(*) AS cells, {_FIX.format("avg(median)")} AS mean, {_FIX.format("max(median)")} AS most,
  {_FIX.format("stddev_pop(median)")} AS std, {_FIX.format("quantile_cont(median, 9.9e-1)")} AS q99, (SELECT {_FIX.format("median(dep)")} FROM e) AS overall FROM g""")
def grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, maximum, spread and 99 % quantile of the map's medians, and the median of all its events."""
    m, grid = F.col("median"), statistics.Grid()
    e = table(spark, sf_dir, "catalog_event")
    done = staged(statistics.grid_windows(e, "dep", grid), "medians")
    one = done.agg(F.count("*").alias("cells"), fixed(F.avg(m)).alias("mean"), fixed(F.max(m)).alias("most"), fixed(F.stddev_pop(m)).alias("std"))
    inside = e.where(F.col("lat").between(grid.lat0, grid.lat1) & F.col("lon").between(grid.lon0, grid.lon1))
    at = lambda df, c, share, name: statistics.quantiles(df, c, [share]).select(fixed(F.get("q", F.lit(0))).alias(name))
    return one.join(at(done, "median", 0.99, "q99")).join(at(inside, "dep", 0.5, "overall"))  # one row each


@query("SELECT count(dep) AS n, median(dep) AS median FROM catalog_event")
def depth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and median of all known depths."""
    e = table(spark, sf_dir, "catalog_event")
    return e.agg(F.count("dep").alias("n")).join(statistics.quantiles(e, "dep", [0.5]).select(F.get("q", F.lit(0)).alias("median")))  # one row each


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS n, {_FIX.format(f'avg({c})')} AS mean, {_FIX.format(f'median({c})')} AS median FROM catalog_event" for c in ("rms", "erh", "erv")))
def solution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, mean and median of the residuals and errors of all events."""
    e = table(spark, sf_dir, "catalog_event")
    rows = []
    for c in ("rms", "erh", "erv"):
        known = e.select(F.when(~F.isnan(c), F.col(c)).alias("v"))
        one = known.agg(F.lit(c).alias("field"), F.count("v").alias("n"), fixed(F.avg("v")).alias("mean"))
        rows.append(one.join(statistics.quantiles(known, "v", [0.5]).select(fixed(F.get("q", F.lit(0))).alias("median"))))  # one row each
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(f"""SELECT CAST(year(event_dt) AS INTEGER) AS year, count(*) AS n, {_FIX.format("avg(az_gap)")} AS az_gap, {_FIX.format("avg(rms)")} AS rms
FROM (SELECT event_dt AT TIME ZONE 'UTC' AS event_dt, az_gap, rms FROM catalog_event) WHERE year(event_dt) BETWEEN 2017 AND 2024 GROUP BY 1""")
def year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean gap and residual by year, of the years 2017 to 2024."""
    e = table(spark, sf_dir, "catalog_event").withColumn("year", F.year("event_dt")).where("year BETWEEN 2017 AND 2024")
    return e.groupBy("year").agg(F.count("*").alias("n"), fixed(F.avg("az_gap")).alias("az_gap"), fixed(F.avg("rms")).alias("rms"))


@query(f"SELECT event_uid AS id, {_FIX.format('lat')} AS lat, {_FIX.format('lon')} AS lon FROM catalog_event WHERE lat BETWEEN 30 AND 60 AND lon IS NOT NULL")
def lambert93_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions found again from their projection to the millimetre."""
    lat, lon = geo.from_lambert93(F.col("x"), F.col("y"))
    return lambert93(spark, sf_dir).select("id", fixed(lat).alias("lat"), fixed(lon).alias("lon"))


@query("SELECT source, id, us FROM (SELECT source, event_uid AS id, epoch_us(event_dt) AS us FROM catalog_event) UNION SELECT 'raw ' || source, raw_id, epoch_us(received_ts) FROM event_raw")
def union_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two catalogs as one, repeated rows once."""
    raw = table(spark, sf_dir, "event_raw").select(F.concat_ws(" ", F.lit("raw"), "source").alias("source"), F.col("raw_id").alias("id"), F.unix_micros("received_ts").alias("us"))
    return _events(spark, sf_dir).select("source", "id", "us").unionByName(raw).distinct()


@query("""SELECT source, 1976 + 5 * ((year(event_dt) - 1976) // 5) AS first_year, count(*) AS n
FROM (SELECT source, event_dt AT TIME ZONE 'UTC' AS event_dt FROM catalog_event WHERE event_dt IS NOT NULL) GROUP BY 1, 2""")
def period_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each source by periods of five years."""
    e = table(spark, sf_dir, "catalog_event").where(F.col("event_dt").isNotNull())
    first = (1976 + 5 * F.floor((F.year("event_dt") - 1976) / 5)).alias("first_year")
    return e.groupBy("source", first).agg(F.count("*").alias("n"))


@query("""SELECT event_uid AS id, 'EVENT_' || lpad(CAST(row_number() OVER (ORDER BY epoch_us(event_dt), event_uid) AS VARCHAR), 9, '0') AS public_id
FROM catalog_event WHERE event_dt IS NOT NULL""")
def public_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chronological identifiers without gaps."""
    e = table(spark, sf_dir, "catalog_event").where(F.col("event_dt").isNotNull()).select("event_uid", "event_dt")
    done = numbered(e, [F.col("event_dt"), F.col("event_uid")], "k")
    return done.select(F.col("event_uid").alias("id"), F.concat(F.lit("EVENT_"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("public_id"))


@query("""SELECT event_uid AS id, CAST(round_even(epoch_us(event_dt) / 1e4, 0) * 10000 AS BIGINT) AS origin_us FROM catalog_event WHERE event_dt IS NOT NULL""")
def round_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin times to 10 ms, carried over."""
    e = table(spark, sf_dir, "catalog_event").where(F.col("event_dt").isNotNull())
    return e.select(F.col("event_uid").alias("id"), seismic.rounded_origin_us(F.unix_micros("event_dt")).alias("origin_us"))


def _section(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "catalog_event").where("erv < 5 AND erh < 5 AND rms < 0.5")
    along, across = geo.along_section(F.col("lat"), F.col("lon"), 42.5, -1.0, 90.0)
    return e.select(F.col("event_uid").alias("id"), "dep", along.alias("along"), across.alias("across"))


_SECTION = """
WITH e AS (SELECT event_uid AS id, dep, lat, lon FROM catalog_event WHERE erv < 5 AND erh < 5 AND rms < 5e-1),
d AS (SELECT id, dep, 2e0 * asin(sqrt(least(1e0, sin(radians(lat - 4.25e1) / 2) * sin(radians(lat - 4.25e1) / 2)
   + cos(radians(4.25e1)) * cos(radians(lat)) * sin(radians(lon + 1e0) / 2) * sin(radians(lon + 1e0) / 2)))) AS d,
   atan2(sin(radians(lon + 1e0)) * cos(radians(lat)),
     cos(radians(4.25e1)) * sin(radians(lat)) - sin(radians(4.25e1)) * cos(radians(lat)) * cos(radians(lon + 1e0))) - radians(9e1) AS t FROM e),
p AS (SELECT id, dep, atan2(sin(d) * cos(t), cos(d)) * 6371 AS along, asin(sin(d) * sin(t)) * 6371 AS across FROM d)
"""


@query(_SECTION + f"SELECT id, dep, {_FIX.format('along')} AS along, {_FIX.format('across')} AS across FROM p WHERE abs(across) <= 1e1")
def section_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of good quality within 10 km of a section, with their place along it."""
    s = _section(spark, sf_dir).where(F.abs("across") <= 10.0)
    return s.select("id", "dep", fixed(F.col("along")).alias("along"), fixed(F.col("across")).alias("across"))


_N, _C, _R0 = geo.lambert_constants()


@query(f"""WITH e AS (SELECT event_uid AS id, sin(radians(lat)) AS s, {_N!r}::DOUBLE * (radians(lon) - radians(3e0)) AS a FROM catalog_event
  WHERE lat BETWEEN 30 AND 60 AND lon IS NOT NULL),
r AS (SELECT id, a, {_C!r}::DOUBLE * exp(-{_N!r}::DOUBLE * (5e-1 * ln((1 + s) / (1 - s)) - sqrt(6.69438002290e-3) / 2e0 * ln((1 + sqrt(6.69438002290e-3) * s) / (1 - sqrt(6.69438002290e-3) * s)))) AS r FROM e)
SELECT id, floor((7e5 + r * sin(a)) * 1e3 + 5e-1) / 1e3 AS x, floor((6.6e6 + {_R0!r}::DOUBLE - r * cos(a)) * 1e3 + 5e-1) / 1e3 AS y FROM r""")
def lambert93(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in the Lambert-93 projection, to the millimetre."""
    e = table(spark, sf_dir, "catalog_event").where(F.col("lat").between(30, 60) & F.col("lon").isNotNull())
    x, y = geo.lambert93(F.col("lat"), F.col("lon"))
    return e.select(F.col("event_uid").alias("id"), fixed(x, 3).alias("x"), fixed(y, 3).alias("y"))


@query(f"""WITH s AS (SELECT event_uid AS id, lat, lon FROM catalog_event WHERE abs(lat) < 89 AND lon IS NOT NULL)
SELECT id, {_FIX.format("lat + 2e1 * cos(radians(4.5e1)) / 1.11e2")} AS lat2, {_FIX.format("lon + 2e1 * sin(radians(4.5e1)) / 1.11e2 / cos(radians(lat))")} AS lon2 FROM s""")
def flat_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 20 km to the north-east lead over a flat earth."""
    e = table(spark, sf_dir, "catalog_event").where((F.abs("lat") < 89) & F.col("lon").isNotNull())
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), 45.0, 20.0)
    return e.select(F.col("event_uid").alias("id"), fixed(lat).alias("lat2"), fixed(lon).alias("lon2"))


@query(f"""WITH z AS (SELECT zone_id, lat_min, lon_min, 6371e0 * (radians(lon_max) - radians(lon_min)) * cos((radians(lat_min) + radians(lat_max)) / 2e0) AS x,
  6371e0 * (radians(lat_max) - radians(lat_min)) AS y FROM reloc_zone),
n AS (SELECT e.lat, e.lon, zone_id FROM catalog_event e JOIN reloc_zone ON e.lat BETWEEN lat_min AND lat_max AND e.lon BETWEEN lon_min AND lon_max),
c AS (SELECT zone_id, count(*) AS events FROM n GROUP BY zone_id)
SELECT zone_id, {_FIX.format("degrees(radians(lat_min) - 1e2 / 6371e0)")} AS lat_sw, {_FIX.format("degrees(radians(lon_min) - 1e2 / (6371e0 * cos(radians(lat_min))))")} AS lon_sw,
  CAST(round_even((x + 2e2) / 5e-2, 0) AS BIGINT) AS nx, CAST(round_even((y + 2e2) / 5e-2, 0) AS BIGINT) AS ny, events
FROM z JOIN c USING (zone_id)""")
def grid_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that have events, enlarged by 100 km on each side, with the number of grid points 50 m apart."""
    z = table(spark, sf_dir, "reloc_zone")
    counts = zone_assign(spark, sf_dir).groupBy("zone_id").agg(F.count("*").alias("events"))
    x, y = geo.local_km(F.col("lat_max"), F.col("lon_max"), F.col("lat_min"), F.col("lon_min"))
    lat, lon = geo.from_local_km(F.lit(-100.0), F.lit(-100.0), F.col("lat_min"), F.col("lon_min"))
    points = lambda d: F.bround((d + 200.0) / 0.05).cast("bigint")
    return z.join(counts, "zone_id").select("zone_id", fixed(lat).alias("lat_sw"), fixed(lon).alias("lon_sw"), points(x).alias("nx"), points(y).alias("ny"), "events")


@query("""WITH RECURSIVE e AS (SELECT event_uid AS id, source, seq, epoch_us(event_dt) AS us FROM catalog_event),
near AS (SELECT a.id AS id1, a.seq, b.id AS id2, 0 AS km, abs(a.us - b.us) AS dt_s FROM e a JOIN e b ON a.source = 'LDG' AND b.source <> 'LDG' AND abs(a.us - b.us) <= 2000000), """
       + _in_turn_sql("near", True) + " SELECT id1, id2 FROM taken")
def time_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one source in file order, each with the only event of the others within 2 s that is still free."""
    e = _events(spark, sf_dir, "seq")
    return matching.time_unique(e.where("source = 'LDG'"), e.where("source <> 'LDG'"), 2_000_000)


def _header(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.split(F.regexp_replace("header_line", r"^\s*#?\s*|\s+$", ""), r"\s+")
    return table(spark, sf_dir, "event_report").select("report_uid", tokens.alias("t")).where(F.size("t") == 17)


_HEAD = r"""WITH h AS (SELECT report_uid, regexp_split_to_array(regexp_replace(header_line, '^\s*#?\s*|\s+$', '', 'g'), '\s+') AS t FROM event_report),
s AS (SELECT report_uid, [CASE WHEN isnan(TRY_CAST(x AS DOUBLE)) THEN NULL ELSE TRY_CAST(x AS DOUBLE) END FOR x IN string_split(t[10], ':')] AS m,
  [CASE WHEN isnan(TRY_CAST(x AS DOUBLE)) THEN NULL ELSE TRY_CAST(x AS DOUBLE) END FOR x IN string_split(t[9], ':')] AS d FROM h WHERE len(t) = 17)
"""


@query(_HEAD + f"SELECT report_uid, {_FIX.format('list_avg(list_filter(m, lambda v: v IS NOT NULL))')} AS mag FROM s WHERE len(list_filter(m, lambda v: v IS NOT NULL)) > 0")
def packed_mean_mag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the magnitude slots of each report that has one."""
    mean = seismic.mean_of(seismic.packed(F.get("t", F.lit(9))))
    return _header(spark, sf_dir).select("report_uid", fixed(mean).alias("mag")).where(F.col("mag").isNotNull())


@query(_HEAD + "SELECT report_uid, list_filter(d, lambda v: v IS NOT NULL)[1] AS dep FROM s WHERE len(list_filter(d, lambda v: v IS NOT NULL)) > 0")
def first_non_null_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First known depth slot of each report that has one."""
    first = seismic.first_of(seismic.packed(F.get("t", F.lit(8))))
    return _header(spark, sf_dir).select("report_uid", first.alias("dep")).where(F.col("dep").isNotNull())


def _number(c: Column) -> Column:
    v = c.try_cast("double")
    return F.when(F.isnan(v), None).otherwise(v)


@query(_HEAD + """SELECT report_uid,
  epoch_us(make_timestamp(t[1]::BIGINT, t[2]::BIGINT, t[3]::BIGINT, t[4]::BIGINT, t[5]::BIGINT, 0e0)) + CAST(floor(t[6]::DOUBLE * 1e6 + 5e-1) AS BIGINT) AS origin_us,
  t[7]::DOUBLE AS lat, t[8]::DOUBLE AS lon, t[11] AS mag_type, CASE WHEN isnan(TRY_CAST(t[13] AS DOUBLE)) THEN NULL ELSE TRY_CAST(t[13] AS DOUBLE) END AS phase_count
FROM h WHERE len(t) = 17""")
def obs_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulletin header lines as typed columns."""
    t = lambda i: F.get("t", F.lit(i))
    whole = F.try_make_timestamp(*[t(i).try_cast("int") for i in range(5)], F.lit(0.0))
    us = F.unix_micros(whole) + F.floor(_number(t(5)) * 1e6 + 0.5)
    return _header(spark, sf_dir).select(
        "report_uid", us.alias("origin_us"), _number(t(6)).alias("lat"), _number(t(7)).alias("lon"), t(10).alias("mag_type"), _number(t(12)).alias("phase_count")
    )


# Relocation solutions have no table of their own: lineitem stands for them, one row per zone.
def _solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("public_id"), F.col("l_linenumber").alias("zone"), F.col("l_extendedprice").cast("double").alias("pdf_volume"),
        (F.col("l_partkey") % 360).cast("double").alias("az1"), F.col("l_quantity").cast("double").alias("dip1"), (1.0 + F.col("l_tax").cast("double") * 10).alias("len1"),
        ((F.col("l_partkey") * 7 + 90) % 360).cast("double").alias("az2"), (F.col("l_discount").cast("double") * 100).alias("dip2"),
        (0.5 + F.col("l_tax").cast("double") * 5).alias("len2"), (2.0 + F.col("l_discount").cast("double")).alias("len3"),
    )


_NLL = """WITH nll AS (SELECT l_orderkey AS public_id, l_linenumber AS zone, l_extendedprice::DOUBLE AS pdf_volume, CAST(l_partkey % 360 AS DOUBLE) AS az1,
  l_quantity::DOUBLE AS dip1, 1e0 + l_tax::DOUBLE * 1e1 AS len1, CAST((l_partkey * 7 + 90) % 360 AS DOUBLE) AS az2, l_discount::DOUBLE * 1e2 AS dip2,
  5e-1 + l_tax::DOUBLE * 5e0 AS len2, 2e0 + l_discount::DOUBLE AS len3 FROM lineitem),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY public_id ORDER BY pdf_volume, zone, az1, dip1, len1, az2, dip2, len2, len3) AS k FROM nll) WHERE k = 1)
"""
_RANK = ["pdf_volume", "zone", "az1", "dip1", "len1", "az2", "dip2", "len2", "len3"]


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _solutions(spark, sf_dir).groupBy("public_id").agg(F.min(F.struct(*_RANK)).alias("b")).select("public_id", "b.*")


@query(_NLL + "SELECT public_id, zone, pdf_volume FROM best")
def arg_min_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The solution of least volume of each event; ties by zone, then by every column."""
    return _best(spark, sf_dir).select("public_id", "zone", "pdf_volume")


@query(_NLL + "SELECT public_id, count(*) AS solutions, count(DISTINCT zone) AS zones FROM nll GROUP BY public_id HAVING count(*) > 1")
def duplicate_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with more than one solution."""
    g = _solutions(spark, sf_dir).groupBy("public_id").agg(F.count("*").alias("solutions"), F.countDistinct("zone").alias("zones"))
    return g.where(F.col("solutions") > 1)


_ELL = _NLL + """, ax AS (SELECT public_id, len1, len2, len3, cos(radians(dip1)) * sin(radians(az1)) AS u0, cos(radians(dip1)) * cos(radians(az1)) AS u1, sin(radians(dip1)) AS u2,
  cos(radians(dip2)) * sin(radians(az2)) AS v0, cos(radians(dip2)) * cos(radians(az2)) AS v1, sin(radians(dip2)) AS v2 FROM best),
w AS (SELECT *, u1 * v2 - u2 * v1 AS a0, u2 * v0 - u0 * v2 AS a1, u0 * v1 - u1 * v0 AS a2 FROM ax),
n AS (SELECT *, sqrt(a0 * a0 + a1 * a1 + a2 * a2) AS s FROM w WHERE sqrt(a0 * a0 + a1 * a1 + a2 * a2) > 1e-12),
c AS (SELECT public_id, len1 * len1 * u0 * u0 + len2 * len2 * v0 * v0 + len3 * len3 * (a0 / s) * (a0 / s) AS a,
  len1 * len1 * u0 * u1 + len2 * len2 * v0 * v1 + len3 * len3 * (a0 / s) * (a1 / s) AS b,
  len1 * len1 * u1 * u1 + len2 * len2 * v1 * v1 + len3 * len3 * (a1 / s) * (a1 / s) AS c,
  len1 * len1 * u2 * u2 + len2 * len2 * v2 * v2 + len3 * len3 * (a2 / s) * (a2 / s) AS z FROM n)
"""


@query(_ELL + f"SELECT public_id, {_FIX.format('sqrt((a + c) / 2 + sqrt((a - c) / 2 * ((a - c) / 2) + b * b))')} AS erh, {_FIX.format('sqrt(z)')} AS erv FROM c")
def ellipsoid_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal and vertical errors of the best solutions from their error ellipsoids."""
    return seismic.with_ellipsoid_errors(_best(spark, sf_dir)).select("public_id", fixed(F.col("erh")).alias("erh"), fixed(F.col("erv")).alias("erv"))


@query(_NLL + """SELECT 'joined' AS kind, count(*) AS n FROM orders JOIN best ON o_orderkey = public_id AND o_orderstatus = 'F'
UNION ALL SELECT 'without_solution', count(*) FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') WHERE o_orderkey NOT IN (SELECT public_id FROM best)
UNION ALL SELECT 'without_event', count(*) FROM best WHERE public_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def reloc_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events have a solution, and the orphans on both sides."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("public_id"), F.lit(1).alias("event"))
    both = orders.join(_best(spark, sf_dir).select("public_id", F.lit(1).alias("solution")), "public_id", "full")
    kind = F.when(F.col("event").isNull(), "without_event").when(F.col("solution").isNull(), "without_solution").otherwise("joined")
    kinds = spark.createDataFrame([("joined",), ("without_solution",), ("without_event",)], "kind string")
    return kinds.join(both.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH e AS (SELECT erh, erv FROM catalog_event WHERE erh IS NOT NULL AND erv IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY erh) + (count(*) OVER (PARTITION BY erh) - 1) / 2e0 AS a, rank() OVER (ORDER BY erv) + (count(*) OVER (PARTITION BY erv) - 1) / 2e0 AS b FROM e)
SELECT count(*) AS n, floor(corr(a, b) * 1e6 + 5e-1) / 1e6 AS spearman FROM r""")
def spearman_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of the horizontal and vertical error."""
    done = statistics.spearman(table(spark, sf_dir, "catalog_event"), "erh", "erv")
    return done.select("n", fixed(F.col("spearman")).alias("spearman"))


@query(_PAIRS + f"""SELECT id1, id2, {_FIX.format("(b.lat - a.lat) * 1.1132e2")} AS north_km, {_FIX.format("(b.lon - a.lon) * (1.1132e2 * cos(radians(4.2e1)))")} AS east_km
FROM p JOIN e a ON a.id = id1 JOIN e b ON b.id = id2 WHERE km <= 1.5e1 AND dt_s <= 2e0""")
def match_residuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences in position of strict candidate pairs, in km north and east."""
    one, two = _two_catalogs(spark, sf_dir)
    pairs = matching.candidates(one, two).where("km <= 15 AND dt_s <= 2").select("id1", "id2")
    place = lambda df, n: df.select(F.col("id").alias("id" + n), F.col("lat").alias("lat" + n), F.col("lon").alias("lon" + n))
    both = pairs.join(place(one, "1"), "id1").join(place(two, "2"), "id2")
    east = F.lit(111.32) * F.cos(F.radians(F.lit(42.0)))
    return both.select("id1", "id2", fixed((F.col("lat2") - F.col("lat1")) * 111.32).alias("north_km"), fixed((F.col("lon2") - F.col("lon1")) * east).alias("east_km"))


@query("""WITH e AS (SELECT source, erh, row_number() OVER (PARTITION BY source ORDER BY erh DESC, event_uid) AS place, event_uid AS id FROM catalog_event WHERE erh IS NOT NULL)
SELECT source, place, id, erh FROM e WHERE place <= 20""")
def worst_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty events of each source with the largest horizontal error, in drawing order."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "catalog_event").where(F.col("erh").isNotNull())
    w = Window.partitionBy("source").orderBy(F.col("erh").desc(), "event_uid")
    return e.select("source", F.row_number().over(w).alias("place"), F.col("event_uid").alias("id"), "erh").where("place <= 20")

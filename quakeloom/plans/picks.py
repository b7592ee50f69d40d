"""Queries on picks, magnitudes and stations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions import seismic
from quakeloom.functions.geo import haversine_km
from quakeloom.functions.seismic import fixed
from quakeloom.operators import bands, inventory, picklists, statistics
from quakeloom.operators.units import to_local_magnitude
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


def timed_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks with us: arrival_ts, else origin and travel time; repeated rows once."""
    p = table(spark, sf_dir, "phase_pick").select("pick_id", "event_uid", "pick_seq", "code", "phase", "channel", "arrival_ts", "tt_s").distinct()
    origin = table(spark, sf_dir, "catalog_event").select("event_uid", F.unix_micros("event_dt").alias("origin"))
    us = F.coalesce(F.unix_micros("arrival_ts"), F.col("origin") + F.floor(F.col("tt_s") * 1e6 + 0.5).cast("bigint"))
    return p.join(origin, "event_uid", "left").select("pick_id", "event_uid", "pick_seq", "code", "phase", "channel", us.alias("us"))


PICKS_SQL = """p AS (SELECT DISTINCT pick_id, event_uid, pick_seq, code, phase, channel, epoch_us(arrival_ts) AS at, tt_s FROM phase_pick),
tp AS (SELECT p.pick_id, p.event_uid, p.pick_seq, p.code, p.phase, p.channel,
  coalesce(p.at, epoch_us(e.event_dt) + CAST(floor(p.tt_s * 1e6 + 5e-1) AS BIGINT)) AS us
  FROM p LEFT JOIN catalog_event e USING (event_uid))"""
_P = PICKS_SQL
_FIX = "floor(({}) * 1e6 + 5e-1) / 1e6"
_HAV = (
    "2e0 * 6371e0 * asin(sqrt(least(1e0, sin(radians({2} - {0}) / 2e0) * sin(radians({2} - {0}) / 2e0)"
    " + cos(radians({0})) * cos(radians({2})) * sin(radians({3} - {1}) / 2e0) * sin(radians({3} - {1}) / 2e0))))"
)


@query("WITH " + _P + """ SELECT event_uid, code, letter, pick_seq, pick_id FROM (SELECT *, substr(phase, 1, 1) AS letter,
  row_number() OVER (PARTITION BY event_uid, code, substr(phase, 1, 1) ORDER BY pick_seq, pick_id) AS n FROM p) WHERE n = 1""")
def dedup_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pick of each event, code and phase letter."""
    return picklists.first_picks(table(spark, sf_dir, "phase_pick").select("pick_id", "event_uid", "pick_seq", "code", "phase").distinct())


@query("WITH " + _P + """, k AS (SELECT *, substr(phase, 1, 1) AS letter FROM p)
SELECT event_uid, code, letter, place, pick_id FROM (SELECT *, min(pick_seq) OVER (PARTITION BY event_uid, code, letter) AS place,
  row_number() OVER (PARTITION BY event_uid, code, letter ORDER BY pick_seq DESC, pick_id DESC) AS n FROM k) WHERE n = 1""")
def override_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last pick of each event, code and phase letter, at the first one's place."""
    return picklists.overridden(table(spark, sf_dir, "phase_pick").select("pick_id", "event_uid", "pick_seq", "code", "phase").distinct())


@query("WITH " + _P + " SELECT pick_id, event_uid, row_number() OVER (PARTITION BY event_uid ORDER BY us NULLS LAST, pick_seq, pick_id) AS place FROM tp")
def sort_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of each pick in its event by arrival."""
    return picklists.ordered_picks(timed_picks(spark, sf_dir))


@query("WITH " + _P + """, d AS (SELECT event_uid, count(DISTINCT (code, substr(phase, 1, 1))) AS n FROM p GROUP BY event_uid)
SELECT e.event_uid, e.phase_count AS given, coalesce(d.n, 0) AS counted FROM catalog_event e LEFT JOIN d USING (event_uid)""")
def phase_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phase count of each event as given and as counted."""
    n = dedup_picks(spark, sf_dir).groupBy("event_uid").agg(F.count("*").alias("n"))
    e = table(spark, sf_dir, "catalog_event").select("event_uid", F.col("phase_count").alias("given"))
    return e.join(n, "event_uid", "left").select("event_uid", "given", F.coalesce("n", F.lit(0)).alias("counted"))


@query("WITH " + _P + """ SELECT upper(substr(phase, 1, 1)) AS letter, CASE upper(substr(phase, 1, 1)) WHEN 'P' THEN 5e-2 WHEN 'S' THEN 1.5e-1 END AS err_s, count(*) AS n
FROM p GROUP BY 1, 2""")
def pick_uncertainty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading errors by phase letter."""
    p = table(spark, sf_dir, "phase_pick").select("pick_id", "event_uid", "pick_seq", "code", "phase", "arrival_ts", "tt_s", "channel").distinct()
    return p.groupBy(F.upper(F.substring("phase", 1, 1)).alias("letter"), seismic.pick_error(F.col("phase")).alias("err_s")).agg(F.count("*").alias("n"))


_CODE = "regexp_extract(upper(regexp_replace(code, '\\s+', '', 'g')), '^([^.]+[.][^.]+)', 1)"
_EPOCHS = """, s AS (SELECT code, site_id, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us FROM station_site),
c AS (SELECT tp.pick_id AS pick, tp.us, s.* FROM tp JOIN s USING (code))
"""


@query("WITH " + _P + _EPOCHS + """, g AS (SELECT pick, count(*) AS n, min(site_id) AS only_id,
  count(*) FILTER (WHERE start_us <= us AND (end_us IS NULL OR us <= end_us)) AS m, min(site_id) FILTER (WHERE start_us <= us AND (end_us IS NULL OR us <= end_us)) AS held
  FROM c GROUP BY pick)
SELECT pick, CASE WHEN n = 1 THEN only_id ELSE held END AS site_id FROM g WHERE n = 1 OR m = 1""")
def remap_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site epoch of each bulletin pick: the only one of its code, or the only one that holds its time."""
    return bands.remapped(timed_picks(spark, sf_dir).withColumnRenamed("pick_id", "pick"), table(spark, sf_dir, "station_site"), "pick")


def _temporary(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.regexp_extract(F.upper(F.regexp_replace("code", r"\s+", "")), r"^([^.]+\.[^.]+)", 1)
    letter = F.upper(F.substring(F.trim("phase"), 1, 1))
    return table(spark, sf_dir, "temp_pick").select(
        F.col("temp_id").alias("pick"), code.alias("code"), letter.alias("letter"), F.unix_micros("arrival_ts").alias("us"), F.col("temp_id").alias("ord")
    ).distinct()


_T = f"t AS (SELECT DISTINCT temp_id AS pick, {_CODE} AS code, upper(substr(trim(phase), 1, 1)) AS letter, epoch_us(arrival_ts) AS us FROM temp_pick)"
_TEMP = "WITH " + _T + """, s AS (SELECT code, site_id, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us FROM station_site),
c AS (SELECT t.pick, t.us, CAST(floor(t.us / 86400000000) AS BIGINT) * 86400000000 AS day, CAST(floor(t.us / 60000000) AS BIGINT) * 60000000 AS minute, s.* FROM t JOIN s USING (code))
"""


@query(_TEMP + """, r AS (SELECT pick, site_id, CASE WHEN (start_us IS NULL OR start_us <= day) AND (end_us IS NULL OR day <= end_us) AND day IS NOT NULL
  THEN 2 - (start_us IS NOT NULL)::INT - (end_us IS NOT NULL)::INT ELSE 3 END AS rank FROM c),
b AS (SELECT pick, min(rank || '|' || site_id) FILTER (WHERE rank < 3) AS b, max(site_id) AS last FROM r GROUP BY pick)
SELECT pick, CASE WHEN b IS NULL THEN last ELSE substr(b, 3) END AS site_id, b IS NULL AS fallback FROM b""")
def resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site epoch of each temporary pick by priority of validity bounds, at the resolution of a day."""
    day = F.floor(F.col("us") / 86_400_000_000) * 86_400_000_000
    return bands.by_priority(_temporary(spark, sf_dir).where("us IS NOT NULL"), table(spark, sf_dir, "station_site"), "pick", day).unionByName(
        bands.by_priority(_temporary(spark, sf_dir).where("us IS NULL"), table(spark, sf_dir, "station_site"), "pick", F.lit(None).cast("bigint"))
        .withColumn("fallback", F.lit(True))
    )


@query(_TEMP + """SELECT pick, min(site_id) AS site_id FROM c WHERE (start_us IS NULL OR start_us <= minute) AND (end_us IS NULL OR minute <= end_us)
GROUP BY pick HAVING count(*) = 1""")
def unique_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporary picks whose code has exactly one active epoch."""
    return bands.only_active(_temporary(spark, sf_dir), table(spark, sf_dir, "station_site"), "pick")


@query(f"WITH {_T}, e AS (SELECT event_uid, epoch_us(event_dt) AS origin FROM catalog_event) SELECT pick, event_uid FROM t JOIN e ON origin BETWEEN us - 60000000 AND us")
def pick_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the minute before each temporary pick."""
    e = table(spark, sf_dir, "catalog_event").select("event_uid", F.unix_micros("event_dt").alias("origin"))
    return picklists.with_window(_temporary(spark, sf_dir), e).select("pick", "event_uid")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "catalog_event").select("event_uid", F.unix_micros("event_dt").alias("origin"), "lat", "lon").where(
        "origin IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL"
    )


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = table(spark, sf_dir, "station_site").groupBy("code").agg(F.min(F.struct("site_id", "latitude", "longitude")).alias("s"))
    seen = timed_picks(spark, sf_dir).where("us IS NOT NULL").join(_events(spark, sf_dir), "event_uid").join(at, "code")
    km = haversine_km(F.col("lat"), F.col("lon"), F.col("s.latitude"), F.col("s.longitude"))
    letter = F.upper(F.substring("phase", 1, 1))
    return seen.select("pick_id", "code", letter.alias("letter"), km.alias("km"), ((F.col("us") - F.col("origin")) / 1e6).alias("tt")).where(
        F.col("letter").isin("P", "S")
    )


_OBS = "WITH " + _P + f""", s AS (SELECT code, latitude, longitude FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY site_id) AS k FROM station_site) WHERE k = 1),
o AS (SELECT tp.pick_id, tp.code, upper(substr(tp.phase, 1, 1)) AS letter, {_HAV.format("e.lat", "e.lon", "s.latitude", "s.longitude")} AS km, (tp.us - epoch_us(e.event_dt)) / 1e6 AS tt
  FROM tp JOIN catalog_event e USING (event_uid) JOIN s ON s.code = tp.code
  WHERE tp.us IS NOT NULL AND e.event_dt IS NOT NULL AND e.lat IS NOT NULL AND e.lon IS NOT NULL AND upper(substr(tp.phase, 1, 1)) IN ('P', 'S'))
"""


def _table(spark: SparkSession, sf_dir: str) -> DataFrame:
    # within a tenth of a second of a uniform crust, so that slipped times do not widen the envelope
    o = _observed(spark, sf_dir)
    usual = F.when(F.col("letter") == "P", F.col("km") / 6.0).otherwise(F.col("km") / 3.46)
    return picklists.travel_time_table(o.where(F.abs(F.col("tt") - usual) <= 2.0 + 0.1 * usual), 100.0)


_TABLE = _OBS + """, u AS (SELECT letter, tt, km FROM o WHERE km BETWEEN 0 AND 105 AND tt >= 0
  AND abs(tt - CASE letter WHEN 'P' THEN km / 6e0 ELSE km / 3.46e0 END) <= 2e0 + 1e-1 * CASE letter WHEN 'P' THEN km / 6e0 ELSE km / 3.46e0 END),
k AS (SELECT letter, tt, unnest(range(greatest(floor(km / 5e-1)::INT - 10, 0), floor(km / 5e-1)::INT + 11)) AS k FROM u),
tab AS (SELECT k::INT AS k, k * 5e-1 AS distance, min(tt) FILTER (WHERE letter = 'P') AS tp_low, max(tt) FILTER (WHERE letter = 'P') AS tp_high,
  min(tt) FILTER (WHERE letter = 'S') AS ts_low, max(tt) FILTER (WHERE letter = 'S') AS ts_high FROM k WHERE k <= 200 GROUP BY k)
"""


@query(_TABLE + "SELECT k, distance, tp_low, tp_high, ts_low, ts_high FROM tab")
def tt_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelope of observed travel times every half kilometre to 100 km."""
    return _table(spark, sf_dir)


@query(_OBS + f"SELECT pick_id, {_FIX.format('km')} AS km, tt FROM o WHERE tt >= 0 AND km <= 100")
def travel_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed travel times within 100 km."""
    return _observed(spark, sf_dir).where("tt >= 0 AND km <= 100").select("pick_id", fixed(F.col("km")).alias("km"), "tt")


@query(_TABLE + f""", q AS (SELECT o.pick_id, o.letter, o.km, floor(o.km / 5e-1)::INT AS i FROM o WHERE o.km <= 100)
SELECT pick_id, {_FIX.format("a.tp_low + (km / 5e-1 - i) * (b.tp_low - a.tp_low)")} AS tp_low, {_FIX.format("a.ts_high + (km / 5e-1 - i) * (b.ts_high - a.ts_high)")} AS ts_high
FROM q JOIN tab a ON a.k = i JOIN tab b ON b.k = least(i + 1, 200)""")
def tt_interpolate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Travel times read from the table between its rows."""
    rows = _table(spark, sf_dir).agg(F.sort_array(F.collect_list(F.struct("k", "tp_low", "tp_high", "ts_low", "ts_high"))).alias("t"))
    o = _observed(spark, sf_dir).where("km <= 100").join(F.broadcast(rows))  # one row
    at = lambda f: fixed(seismic.interpolated(F.col("km"), F.col("t"), f, 0.5)).alias(f)
    return o.select("pick_id", at("tp_low"), at("ts_high"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "temp_pick").select(F.col("temp_id").alias("pick"), F.struct("file_name", "temp_id").alias("ord")).distinct()
    picks = _temporary(spark, sf_dir).where(F.col("us").isNotNull()).drop("ord").join(files, "pick")
    letter = F.upper(F.substring("phase", 1, 1)).alias("letter")
    existing = table(spark, sf_dir, "phase_pick").select("event_uid", "code", letter)
    times = staged(_table(spark, sf_dir), "times")
    return picklists.matched_picks(picks, _events(spark, sf_dir), table(spark, sf_dir, "station_site"), times, existing)


_TT = "CASE letter WHEN 'P' THEN a.tp_{0} + (km / 5e-1 - i) * (b.tp_{0} - a.tp_{0}) ELSE a.ts_{0} + (km / 5e-1 - i) * (b.ts_{0} - a.ts_{0}) END"
_MATCHED = _TABLE + f""", {_T.replace("t AS (", "tq AS (")},
cand AS (SELECT tq.pick, tq.letter, e.event_uid, s.code IS NOT NULL AS placed, (tq.us - epoch_us(e.event_dt)) / 1e6 AS tt, {_HAV.format("e.lat", "e.lon", "s.latitude", "s.longitude")} AS km
  FROM tq JOIN catalog_event e ON epoch_us(e.event_dt) BETWEEN tq.us - 60000000 AND tq.us LEFT JOIN s ON s.code = tq.code WHERE e.lat IS NOT NULL AND e.lon IS NOT NULL),
fit AS (SELECT pick, event_uid, placed, coalesce(tt BETWEEN {_TT.format("low")} - slack AND {_TT.format("high")} + slack, FALSE) AS fits
  FROM (SELECT *, floor(km / 5e-1)::INT AS i, CASE letter WHEN 'P' THEN 1e-1 + 2.5e0 ELSE 3e-1 + 2.5e0 END AS slack FROM cand) LEFT JOIN tab a ON a.k = i AND km <= 100 LEFT JOIN tab b ON b.k = least(i + 1, 200)),
seen AS (SELECT pick, bool_or(placed) AS placed, count(*) FILTER (WHERE fits) AS n_fit, min(event_uid) FILTER (WHERE fits) AS event_uid FROM fit GROUP BY pick),
told AS (SELECT tq.pick, tq.code, tq.letter, seen.event_uid, f.file_name,
  CASE WHEN seen.pick IS NULL THEN 'no_event' WHEN NOT placed THEN 'no_station' WHEN n_fit = 0 THEN 'no_residual' WHEN n_fit > 1 THEN 'multi' END AS reason
  FROM tq LEFT JOIN seen USING (pick) JOIN (SELECT DISTINCT temp_id AS pick, file_name FROM temp_pick) f ON f.pick = tq.pick WHERE tq.us IS NOT NULL),
st AS (SELECT pick, event_uid, CASE WHEN reason IS NOT NULL THEN reason WHEN (event_uid, code, letter) IN (SELECT (event_uid, code, upper(substr(phase, 1, 1))) FROM phase_pick)
    OR row_number() OVER (PARTITION BY event_uid, code, letter, reason IS NULL ORDER BY file_name, pick) > 1 THEN 'duplicate' ELSE 'matched' END AS status FROM told)
"""


@query(_MATCHED + "SELECT pick, status, CASE WHEN status = 'matched' THEN event_uid END AS event_uid FROM st")
def match_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporary picks, file by file, attached to the only event whose travel time fits, or the reason against it."""
    return _matched(spark, sf_dir)


@query(_MATCHED + "SELECT status, count(*) AS n FROM st GROUP BY status")
def match_picks_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many temporary picks were matched, and why the others were not."""
    return _matched(spark, sf_dir).groupBy("status").agg(F.count("*").alias("n"))


@query(_OBS + """SELECT code, letter, count(*) AS n, floor(avg(tt - km / CASE letter WHEN 'P' THEN 6e0 ELSE 3.46e0 END) * 1e4 + 5e-1) / 1e4 AS mean,
  floor(stddev_samp(tt - km / CASE letter WHEN 'P' THEN 6e0 ELSE 3.46e0 END) * 1e4 + 5e-1) / 1e4 AS std
FROM o WHERE km <= 100 AND abs(tt) <= 60 GROUP BY 1, 2 HAVING count(*) >= 20""")
def station_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of each station's and phase's delay, for those with at least 20 readings."""
    o = _observed(spark, sf_dir).where((F.col("km") <= 100) & (F.abs("tt") <= 60))
    delay = F.col("tt") - F.col("km") / F.when(F.col("letter") == "P", 6.0).otherwise(3.46)
    g = o.groupBy("code", "letter").agg(F.count("*").alias("n"), fixed(F.avg(delay), 4).alias("mean"), fixed(F.stddev_samp(delay), 4).alias("std"))
    return g.where("n >= 20")


@query(_OBS + """SELECT tp.pick_id FROM tp LEFT JOIN o USING (pick_id) WHERE o.km IS NULL OR o.km <= 80""")
def far_pick_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Picks at most 80 km from their event, and those whose distance is unknown."""
    known = _observed(spark, sf_dir).select("pick_id", "km")
    return timed_picks(spark, sf_dir).select("pick_id").join(known, "pick_id", "left").where("km IS NULL OR km <= 80").select("pick_id")


_SHARED = "WITH " + _P + """, pair AS (SELECT a.event_uid AS id1, b.event_uid AS id2 FROM catalog_event a JOIN catalog_event b
  ON a.source = 'RESIF' AND b.source = 'LDG' AND abs(epoch_us(a.event_dt) - epoch_us(b.event_dt)) < 5000000),
r AS (SELECT id1, id2, 1 AS side, pick_seq, code, phase, us FROM pair JOIN tp ON event_uid = id1 WHERE us IS NOT NULL AND phase NOT LIKE 'S%'
  UNION ALL SELECT id1, id2, 2, pick_seq, code, phase, us FROM pair JOIN tp ON event_uid = id2 WHERE us IS NOT NULL AND phase NOT LIKE 'S%'),
f AS (SELECT *, first_value(us) OVER (PARTITION BY id1, id2, code, phase ORDER BY side, pick_seq, us) AS first_us FROM r),
k AS (SELECT id1, id2, code, phase FROM f WHERE abs(us - first_us) <= 1000000 GROUP BY 1, 2, 3, 4 HAVING count(*) > 1)
SELECT id1, id2, count(*) AS n FROM k GROUP BY 1, 2"""


@query(_SHARED)
def shared_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings that events of two sources within 5 s have in common."""
    from quakeloom.operators.bands import band_join
    from quakeloom.operators.matching import shared_picks as shared

    e = table(spark, sf_dir, "catalog_event").select("event_uid", "source", F.unix_micros("event_dt").alias("us"))
    one = e.where("source = 'RESIF'").select(F.col("event_uid").alias("id1"), F.col("us").alias("us1"))
    two = e.where("source = 'LDG'").select(F.col("event_uid").alias("id2"), F.col("us").alias("us2"))
    pairs = band_join(one, two, "us1", "us2", -4_999_999, 4_999_999).select("id1", "id2")
    return shared(pairs, timed_picks(spark, sf_dir))


@query(f"WITH {_T}, u AS (SELECT DISTINCT code FROM t WHERE code <> '') SELECT code, 'XX' AS network FROM u WHERE code NOT IN (SELECT code FROM station_site)")
def anti_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of temporary picks that the inventory does not know, under a network of their own."""
    seen = _temporary(spark, sf_dir).where("code <> ''").select("code").distinct()
    return seen.join(table(spark, sf_dir, "station_site").select("code"), "code", "left_anti").select("code", F.lit("XX").alias("network"))


@query("""SELECT network, code, count(*) AS epochs, epoch_us(min(start_ts)) AS start_us,
  CASE WHEN count(end_ts) = count(*) THEN epoch_us(max(end_ts)) END AS end_us,
  coalesce(arg_min(elevation, (coalesce(start_ts, TIMESTAMPTZ '1900-01-01 00:00:00+00'), site_id)) FILTER (WHERE elevation <> 0), 0) AS elevation,
  arg_min(site_id, (coalesce(start_ts, TIMESTAMPTZ '1900-01-01 00:00:00+00'), site_id)) AS oldest_site
FROM station_site GROUP BY network, code""")
def station_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epochs of each code merged into one."""
    m = inventory.merged_stations(table(spark, sf_dir, "station_site"))
    return m.select("network", "code", "epochs", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"), "elevation", "oldest_site")


@query("""WITH c AS (SELECT network, code, min(site_id) AS first_id FROM station_site GROUP BY 1, 2)
SELECT code, network || '.' || lpad(CAST(row_number() OVER (PARTITION BY network ORDER BY first_id) - 1 AS VARCHAR), 4, '0') AS alt_code FROM c""")
def alt_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running codes for the stations of each network."""
    return inventory.numbered_codes(table(spark, sf_dir, "station_site"))


_NEAR = f"""pair AS (SELECT a.site_id AS x, b.site_id AS y FROM station_site a JOIN station_site b ON a.site_id <> b.site_id {{0}}
  AND {_HAV.format("a.latitude", "a.longitude", "b.latitude", "b.longitude")} <= 5e-2),
reach AS (SELECT x, y FROM pair UNION SELECT r.x, p.y FROM reach r JOIN pair p ON r.y = p.x)
SELECT x AS site_id, least(x, min(y)) AS cluster FROM reach GROUP BY x"""


@query("WITH RECURSIVE " + _NEAR.format("AND a.code = b.code"))
def station_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of one code linked by steps of at most 50 m."""
    return inventory.site_clusters(table(spark, sf_dir, "station_site"), 0.05, True)


@query("WITH RECURSIVE " + _NEAR.format(""))
def coloc_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of any network linked by steps of at most 50 m."""
    return inventory.site_clusters(table(spark, sf_dir, "station_site"), 0.05, False)


@query("""SELECT CASE WHEN network IN ('FR', 'RD', 'RA', 'ES', 'CA', 'LC') THEN 'permanent' WHEN network = 'AM' THEN 'citizen' ELSE 'temporary' END AS class,
  network, count(DISTINCT code) AS stations FROM station_site GROUP BY 1, 2""")
def network_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stations by network and kind of network."""
    s = table(spark, sf_dir, "station_site")
    return s.groupBy(seismic.network_class(F.col("network")).alias("class"), "network").agg(F.countDistinct("code").alias("stations"))


@query("WITH " + _P + """, u AS (SELECT DISTINCT code FROM p), s AS (SELECT code, max_by(latitude, site_id) AS latitude, max_by(longitude, site_id) AS longitude, max_by(elevation, site_id) AS elevation FROM station_site GROUP BY code)
SELECT printf('GTSRCE %s LATLON %.6f %.6f 0.0 %.3f', code, latitude, longitude, elevation / 1000e0) AS line FROM u JOIN s USING (code)""")
def gtsrce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station lines of a travel-time program for all stations that have picks; the last epoch gives the place."""
    used = table(spark, sf_dir, "phase_pick").select("code").distinct()
    last = table(spark, sf_dir, "station_site").groupBy("code").agg(F.max(F.struct("site_id", "latitude", "longitude", "elevation")).alias("s"))
    line = F.format_string("GTSRCE %s LATLON %.6f %.6f 0.0 %.3f", "code", "s.latitude", "s.longitude", F.col("s.elevation") / 1000)
    return used.join(last, "code").select(line.alias("line"))


@query(r"""WITH r AS (SELECT report_uid, unnest(picks) AS line, generate_subscripts(picks, 1) AS k FROM event_report)
SELECT report_uid, CAST(k AS INTEGER) AS pick_seq, trim(substr(line, 1, 9)) AS code, trim(substr(line, 23, 6)) AS phase,
  epoch_us(make_timestamp(substr(line, 32, 4)::BIGINT, substr(line, 36, 2)::BIGINT, substr(line, 38, 2)::BIGINT, substr(line, 41, 2)::BIGINT, substr(line, 43, 2)::BIGINT, 0e0))
    + CAST(floor(trim(substr(line, 46, 6))::DOUBLE * 1e6 + 5e-1) AS BIGINT) AS us, TRY_CAST(trim(substr(line, 57, 9)) AS DOUBLE) AS err_s FROM r""")
def obs_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bulletin pick lines of fixed columns as typed columns."""
    from quakeloom.sources.obs import pick_columns

    r = table(spark, sf_dir, "event_report").select("report_uid", F.posexplode("picks").alias("k", "line"))
    c = pick_columns(F.col("line"))
    return r.select("report_uid", (F.col("k") + 1).alias("pick_seq"), c["code"].alias("code"), c["phase"].alias("phase"), c["us"].alias("us"), c["err_s"].alias("err_s"))


# magnitudes

_NUM = r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　 "
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  "
# Magnitudes in common units, written as rules on the spelling instead of a dictionary of spellings.
UNITS_SQL = rf"""u0 AS (SELECT DISTINCT mag_id, event_uid, mag AS given, lower(trim(coalesce(mag_type, ''))) AS kind, upper(trim(mag_author)) AS mag_author, trim(coalesce(remark, '')) AS note,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(mag, '{_WIDE.replace("'", "''")}', '{_NARROW.replace("'", "''")}'),
    '^\s+|\s+$', '', 'g'), '([0-9]),([0-9])', '\1.\2', 'g'), '\s*(±|\+/-)\s*[0-9.]+', '', 'g'), '[Mm]0([^.0-9]|$)', 'Mo\1', 'g'), 'log10', 'log', 'gi'),
    '\s*[x×*·]\s*10\^([+-]?[0-9]+)', 'e\1', 'g') AS s FROM org_mag),
u1 AS (SELECT *, TRY_CAST(regexp_extract(s, '{_NUM}') AS DOUBLE) AS v, regexp_replace(s, '{_NUM}', ' ') AS beside FROM u0),
u2 AS (SELECT *, regexp_replace(lower(beside), '[^a-z]', '', 'g') AS l FROM u1 WHERE v IS NOT NULL),
u3 AS (SELECT *, CASE WHEN regexp_matches(beside, '^\s*x\s*0\.01\s*$|^\s*/\s*100\s*$') OR l = 'cm' THEN 'hundredth' WHEN regexp_matches(beside, '^\s*x\s*0\.1\s*$|^\s*/\s*10\s*$') OR l = 'dm' THEN 'tenth'
    WHEN l IN ('nm', 'monm') THEN 'newton_metre' WHEN l IN ('dyncm', 'dynecm', 'modyncm', 'modynecm') THEN 'dyne_centimetre'
    WHEN l IN ('lgmonm', 'logmonm') THEN 'lg_newton_metre' WHEN l IN ('lgmodyncm', 'lgmodynecm', 'logmodyncm', 'logmodynecm') THEN 'lg_dyne_centimetre'
    WHEN l IN ('', 'm', 'ml', 'mlv', 'md', 'mw', 'mblg', 'mb') AND NOT regexp_matches(beside, '[0-9/]') THEN 'plain' END AS tu,
  CASE WHEN l IN ('ml', 'mlv', 'md', 'mw', 'mblg', 'mb') THEN l END AS ts,
  CASE WHEN kind IN ('ml', 'mlv', 'md', 'mw', 'mblg', 'mb') THEN kind WHEN kind IN ('m0', 'mo') THEN 'mw' END AS ks,
  CASE WHEN note IN ('in hundredths', 'centièmes', 'centésimas de magnitud', 'x100', 'mag*100') THEN 'hundredth'
    WHEN note IN ('tenths', 'dixièmes de magnitude', 'en décimas', 'x10', 'mag*10') THEN 'tenth'
    WHEN regexp_matches(note, '^(M0 in |moment \(|moment sismique en )?N[ .·]?m\)?$') THEN 'newton_metre'
    WHEN regexp_matches(note, '^(M0 in |moment \(|moment sismique en )?dyne?[ .-]cm\)?$') THEN 'dyne_centimetre' END AS nu FROM u2),
u4 AS (SELECT *, coalesce(CASE WHEN tu <> 'plain' THEN tu WHEN ts IS NULL THEN nu END, CASE WHEN v BETWEEN 10 AND 1000 THEN 'hundredth' WHEN v > 1e6 THEN 'newton_metre' END, 'plain') AS unit FROM u3
  WHERE tu IS NOT NULL AND v NOT IN (-999, 9.9e0) AND v >= -5),
u5 AS (SELECT *, CASE unit WHEN 'hundredth' THEN v / 100 WHEN 'tenth' THEN v / 10 WHEN 'newton_metre' THEN 2e0 / 3e0 * (log10(v) - 9.1e0) WHEN 'dyne_centimetre' THEN 2e0 / 3e0 * (log10(v) - 7 - 9.1e0)
    WHEN 'lg_newton_metre' THEN 2e0 / 3e0 * (v - 9.1e0) WHEN 'lg_dyne_centimetre' THEN 2e0 / 3e0 * (v - 7 - 9.1e0) ELSE CASE WHEN v <= 10 THEN v END END AS magnitude,
  CASE WHEN unit LIKE '%metre' THEN 'mw' ELSE coalesce(ts, ks) END AS scale FROM u4),
um AS (SELECT u5.*, CASE WHEN slope IS NULL THEN magnitude ELSE slope * magnitude + intercept END AS ml FROM u5 LEFT JOIN mag_model d
  ON lower(trim(d.mag_type)) = scale AND upper(trim(d.mag_author)) = u5.mag_author AND d.seg = CASE WHEN magnitude >= 2 THEN '>=2' ELSE '<2' END WHERE magnitude IS NOT NULL)"""
MAGS_SQL = UNITS_SQL + ", m AS (SELECT mag_id, event_uid, floor(magnitude * 1e6 + 5e-1) / 1e6 AS mag, scale AS mag_type, mag_author FROM um)"
_M = MAGS_SQL


def mags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mag_id, event_uid, mag, mag_type, mag_author): every usable magnitude in common units, on the scale that it is given on."""
    columns = ["mag_id", "event_uid", "mag", "mag_type", "mag_author", "remark"]
    done = to_local_magnitude(table(spark, sf_dir, "org_mag").select(*columns).distinct(), table(spark, sf_dir, "mag_model"))
    return done.where(F.col("magnitude").isNotNull()).select(
        "mag_id", "event_uid", fixed(F.col("magnitude")).alias("mag"), F.col("scale").alias("mag_type"), F.upper(F.trim("mag_author")).alias("mag_author")
    )


@query("SELECT mag_type, mag_author, count(*) AS n FROM org_mag GROUP BY 1, 2")
def mag_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each type and author is given, as written."""
    return table(spark, sf_dir, "org_mag").groupBy("mag_type", "mag_author").agg(F.count("*").alias("n"))


@query(f"WITH {_M}, l AS (SELECT mag_id, mag, d.slope, d.intercept FROM m LEFT JOIN mag_model d ON lower(trim(d.mag_type)) = m.mag_type AND upper(trim(d.mag_author)) = m.mag_author AND d.seg = CASE WHEN m.mag >= 2 THEN '>=2' ELSE '<2' END)"
       + f" SELECT mag_id, {_FIX.format('CASE WHEN slope IS NULL THEN mag ELSE slope * mag + intercept END')} AS ml FROM l")
def apply_mag_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitudes converted by the model of their type and author; without a model unchanged."""
    m = mags(spark, sf_dir).withColumn("seg", F.when(F.col("mag") >= 2, ">=2").otherwise("<2"))
    ml = F.when(F.col("slope").isNull(), F.col("mag")).otherwise(F.col("slope") * F.col("mag") + F.col("intercept"))
    model = table(spark, sf_dir, "mag_model").withColumns({"mag_type": F.lower(F.trim("mag_type")), "mag_author": F.upper(F.trim("mag_author"))})
    return m.join(model, ["mag_type", "mag_author", "seg"], "left").select("mag_id", fixed(ml).alias("ml"))


@query(f"WITH {_M} SELECT mag_id, {_FIX.format('CASE WHEN mag < 3.117e0 THEN 6.642e-1 * mag + 4.467e-1 WHEN mag <= 4 THEN mag - 6e-1 ELSE 1.4285e0 * mag - 2.0891e0 END')} AS mw FROM m WHERE mag_type = 'ml'")
def ml_to_mw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moment magnitudes from local ones."""
    return mags(spark, sf_dir).where("mag_type = 'ml'").select("mag_id", fixed(seismic.ml_to_mw(F.col("mag"))).alias("mw"))


@query(f"WITH {_M}, c AS (SELECT mag, count(*) AS n FROM m WHERE mag_type = 'ml' GROUP BY mag) SELECT mag, n, CAST(sum(n) OVER (ORDER BY mag DESC) AS BIGINT) AS n_at_least FROM c")
def gutenberg_richter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Magnitude-frequency counts."""
    return statistics.cumulative_counts(mags(spark, sf_dir).where("mag_type = 'ml'"))


def _mag_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = staged(mags(spark, sf_dir).where(F.col("mag_type").isNotNull()), "magnitudes")
    y = m.where("mag_type = 'ml' AND mag_author = 'LDG'").groupBy("event_uid").agg(F.min("mag").alias("y"))
    x = m.where("NOT (mag_type = 'ml' AND mag_author = 'LDG')").select("event_uid", "mag_type", "mag_author", F.col("mag").alias("x"))
    return x.join(y, "event_uid")


_FIT = f"""WITH {_M}, y AS (SELECT event_uid, min(mag) AS y FROM m WHERE mag_type = 'ml' AND mag_author = 'LDG' GROUP BY 1),
xy AS (SELECT m.mag_type, m.mag_author, m.mag AS x, y.y FROM m JOIN y USING (event_uid) WHERE m.mag_type IS NOT NULL AND NOT (m.mag_type = 'ml' AND m.mag_author = 'LDG')),
u AS (SELECT mag_type, mag_author, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM xy WHERE x >= 2 GROUP BY 1, 2),
l AS (SELECT *, (syy - sxx + sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy) AS slope FROM u WHERE abs(sxy) > 1e-9 AND n >= 10),
f AS (SELECT *, my - slope * mx AS intercept FROM l),
p AS (SELECT xy.mag_type, xy.mag_author, sum((x - 2) * (y - (slope * 2 + intercept))) / sum((x - 2) * (x - 2)) AS slope_low FROM xy JOIN f USING (mag_type, mag_author) WHERE x < 2 GROUP BY 1, 2)
SELECT f.mag_type, f.mag_author, f.n, floor(slope * 1e4 + 5e-1) / 1e4 AS slope, floor(intercept * 1e4 + 5e-1) / 1e4 AS intercept,
  floor(slope_low * 1e4 + 5e-1) / 1e4 AS slope_low FROM f LEFT JOIN p USING (mag_type, mag_author)"""


@query(_FIT)
def magnitude_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-piece lines from each type and author to the ML of LDG, over events that have both."""
    done = statistics.two_piece_fits(_mag_pairs(spark, sf_dir), ["mag_type", "mag_author"]).where("n >= 10")
    return done.select("mag_type", "mag_author", "n", *[fixed(F.col(c), 4).alias(c) for c in ("slope", "intercept", "slope_low")])


@query(_FIT.partition("SELECT f.mag_type")[0] + """, r AS (SELECT f.mag_type, f.mag_author, xy.y - (slope * xy.x + intercept) AS res, f.syy FROM xy JOIN f USING (mag_type, mag_author) WHERE xy.x >= 2),
q AS (SELECT mag_type, mag_author, quantile_cont(res, 2.5e-1) AS q1, quantile_cont(res, 7.5e-1) AS q3 FROM r GROUP BY 1, 2)
SELECT mag_type, mag_author, count(*) AS n, floor(avg(res * res) * 1e4 + 5e-1) / 1e4 AS sigma2, floor((1 - avg(res * res) / max(syy)) * 1e4 + 5e-1) / 1e4 AS r2,
  floor(stddev_samp(res) * 1e4 + 5e-1) / 1e4 AS band, floor((4 * ln(count(*)) + count(*) * ln(2 * pi() * avg(res * res)) + count(*)) * 1e3 + 5e-1) / 1e3 AS bic,
  count(*) FILTER (WHERE res < q1 - 1.5e0 * (q3 - q1) - 1e-9 OR res > q3 + 1.5e0 * (q3 - q1) + 1e-9) AS outliers
FROM r JOIN q USING (mag_type, mag_author) GROUP BY 1, 2""")
def fit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the upper lines fit: residual variance, R2, prediction band, information criterion, outliers beyond 1.5 quartile ranges."""
    by = ["mag_type", "mag_author"]
    done = statistics.fit_diagnostics(_mag_pairs(spark, sf_dir), by).where("n >= 10")
    return done.select(*by, "n", *[fixed(F.col(c), 4).alias(c) for c in ("sigma2", "r2", "band")], fixed(F.col("bic"), 3).alias("bic"), "outliers")


@query(_TEMP + """, n AS (SELECT DISTINCT pick, code FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.pick = c.pick
  AND (d.start_us IS NULL OR d.start_us <= d.day) AND (d.end_us IS NULL OR d.day <= d.end_us) AND d.day IS NOT NULL))
SELECT code, count(*) AS n FROM n GROUP BY code""")
def fallback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many temporary picks of each code fall into no epoch and take the last one."""
    code = _temporary(spark, sf_dir).select("pick", "code")
    return resolve_priority(spark, sf_dir).where("fallback").join(code, "pick").groupBy("code").agg(F.count("*").alias("n"))


@query("SELECT code, string_agg(DISTINCT channel, ' ' ORDER BY channel) AS channels FROM phase_pick WHERE channel <> '?' GROUP BY code")
def channel_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All channels that picks of a station were read on."""
    p = table(spark, sf_dir, "phase_pick").where("channel <> '?'")
    return p.groupBy("code").agg(F.array_join(F.sort_array(F.collect_set("channel")), " ").alias("channels"))


@query("SELECT site_id, code FROM station_site WHERE code IN (SELECT code FROM phase_pick)")
def removed_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inventory without the stations of a removal table, here those that no event was read at."""
    sites = table(spark, sf_dir, "station_site")
    removal = sites.join(table(spark, sf_dir, "phase_pick").select("code"), "code", "left_anti").select("network", "station").distinct()
    return inventory.without_stations(sites, removal).select("site_id", "code")


@query("WITH RECURSIVE " + _NEAR.format("AND a.code = b.code").partition("SELECT x AS site_id")[0] + """, c AS (SELECT s.code, s.site_id, coalesce(least(s.site_id, min(r.y)), s.site_id) AS cluster
  FROM station_site s LEFT JOIN reach r ON r.x = s.site_id GROUP BY 1, 2),
k AS (SELECT *, dense_rank() OVER (PARTITION BY code ORDER BY cluster) - 1 AS k FROM c)
SELECT site_id, CASE WHEN k = 0 THEN code ELSE code || '_' || k END AS code FROM k""")
def renamed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of one code that lie apart get codes of their own: code, code_1, ... by their clusters' first site."""
    return inventory.renamed_sites(table(spark, sf_dir, "station_site"), 0.05)


@query(f"WITH {_M}, b AS (SELECT event_uid, max(mag) AS mag FROM m GROUP BY 1) SELECT event_uid, mag FROM b WHERE mag >= 1")
def least_magnitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose greatest magnitude is at least 1."""
    return mags(spark, sf_dir).groupBy("event_uid").agg(F.max("mag").alias("mag")).where("mag >= 1")


@query("""WITH l AS (SELECT code, max_by(latitude, site_id) AS latitude, max_by(longitude, site_id) AS longitude, max_by(elevation, site_id) AS elevation FROM station_site GROUP BY code)
SELECT printf('GTSRCE %s LATLON %.4f %.4f 0 %.4f', code, floor(latitude * 1e4 + 5e-1) / 1e4, floor(longitude * 1e4 + 5e-1) / 1e4, abs(elevation) / 1000e0) AS line FROM l""")
def gtsrce_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station lines of all stations with four decimals and the elevation without its sign."""
    last = table(spark, sf_dir, "station_site").groupBy("code").agg(F.max(F.struct("site_id", "latitude", "longitude", "elevation")).alias("s"))
    place = [fixed(F.col(f"s.{c}"), 4) for c in ("latitude", "longitude")]
    return last.select(F.format_string("GTSRCE %s LATLON %.4f %.4f 0 %.4f", "code", *place, F.abs("s.elevation") / 1000).alias("line"))

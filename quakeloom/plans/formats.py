"""Queries that write the tables in each file format and read them back; their SQL looks at the tables alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quakeloom.functions.seismic import fixed
from quakeloom.operators import statistics
from quakeloom.operators.inventory import delays_by_station, numbered_codes
from quakeloom.plans import catalog, picks
from quakeloom.session import new_stage_path, staged, table
from quakeloom.sources import bulletins, external_picks, obs, relocation, stations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _text(lines: DataFrame, name: str) -> str:
    """The only column written as a text file in the shared folder."""
    path = new_stage_path(lines.sparkSession, name)
    lines.write.text(path)
    return path


def _csv(rows: DataFrame, name: str, **options: object) -> str:
    path = new_stage_path(rows.sparkSession, name)
    rows.write.csv(path, **options)
    return path


def _columns(**at: Column) -> Column:
    """A line with texts at columns: c12=text; each is cut or padded to where the next one begins."""
    starts = sorted((int(k[1:]), c) for k, c in at.items())
    parts, here = [], 0
    for i, (start, c) in enumerate(starts):
        if start > here:
            parts.append(F.lit(" " * (start - here)))
        here = starts[i + 1][0] if i + 1 < len(starts) else start + 12
        parts.append(F.rpad(F.coalesce(c.cast("string"), F.lit("")), here - start, " "))
    return F.concat(*parts)


def _down(us: Column, step: int) -> Column:
    return us - F.pmod(us, F.lit(step))


_NUMBERS = {"lat": 4, "lon": 4, "dep": 2, "phase_count": 1, "erh": 2, "erv": 2, "az_gap": 1, "rms": 4}
_FIXED = lambda c, d: f"floor({c} * 1e{d} + 5e-1) / 1e{d}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = catalog._events_with_mags(spark, sf_dir, "dep", "phase_count", "erh", "erv", "az_gap", "rms").where("us IS NOT NULL")
    return staged(e.select("id", "us", *[fixed(F.col(c), d).alias(c) for c, d in _NUMBERS.items()], fixed(F.col("mag"), 2).alias("mag"), "mag_type", "mag_author"), "events")


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed picks of events with a time: id (of the event), pick_seq, code, phase, channel, us, err_s, origin."""
    more = table(spark, sf_dir, "phase_pick").select("pick_id", "err_s", "origin").distinct()
    timed = picks.timed_picks(spark, sf_dir).where("us IS NOT NULL").join(more, "pick_id")
    known = table(spark, sf_dir, "catalog_event").where("event_dt IS NOT NULL").select("event_uid")
    return timed.join(known, "event_uid", "left_semi").withColumnRenamed("event_uid", "id")


_EV = f"""{catalog._EM}, ev AS (SELECT e.id, us, {", ".join(f"{_FIXED('x.' + c, d)} AS {c}" for c, d in _NUMBERS.items())}, {_FIXED("mag", 2)} AS mag, mag_type, mag_author
  FROM e JOIN catalog_event x ON x.event_uid = e.id WHERE us IS NOT NULL)"""
_PK = f"""{picks.PICKS_SQL}, pk AS (SELECT tp.event_uid AS id, tp.pick_seq, tp.code, tp.phase, tp.channel, tp.us, q.err_s, q.origin, epoch_us(e.event_dt) AS event_us
  FROM tp JOIN (SELECT DISTINCT pick_id, err_s, origin FROM phase_pick) q USING (pick_id) JOIN catalog_event e USING (event_uid) WHERE tp.us IS NOT NULL AND e.event_dt IS NOT NULL)"""


# event blocks


def _bulletin(spark: SparkSession, sf_dir: str) -> str:
    fields = [*_NUMBERS, "mag", "mag_type", "mag_author"]
    head = obs.header_line(_down(F.col("us"), 10_000), **{f: F.col(f) for f in fields})
    events = _events(spark, sf_dir).select(F.col("id").alias("seq"), F.concat(F.lit("E"), "id").alias("public_id"), head.alias("header"))
    line = obs.pick_line(_down(F.col("us"), 1000), **{f: F.col(f) for f in ("code", "phase", "err_s", "channel", "origin")})
    path = new_stage_path(spark, "bulletin")
    obs.write(events, _picks(spark, sf_dir).select(F.col("id").alias("seq"), "pick_seq", line.alias("line")), path)
    return path


@query(f"""WITH {_EV} SELECT 'E' || id AS public_id, us - us % 10000 AS origin_us, lat, lon, dep, mag, mag_type, mag_author, phase_count, erh, erv, az_gap, rms FROM ev""")
def obs_events_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as a bulletin of event blocks and read again."""
    return obs.read_events(spark, _bulletin(spark, sf_dir)).drop("file", "seq")


@query(f"""WITH {_PK} SELECT 'E' || id AS public_id, code, phase, us - us % 1000 AS us, {_FIXED("err_s", 2)} AS err_s, channel, origin FROM pk""")
def obs_picks_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picks of the same bulletin, joined to their events by file and place."""
    path = _bulletin(spark, sf_dir)
    names = obs.read_events(spark, path).select("file", "seq", "public_id")
    return obs.read_picks(spark, path).join(names, ["file", "seq"]).select("public_id", "code", "phase", "us", "err_s", "channel", "origin")


# source bulletins


def _ldg(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = picks.mags(spark, sf_dir).groupBy(F.col("event_uid").alias("id")).agg(
        F.min(F.when(F.col("mag_type") == "ml", F.col("mag"))).alias("ML"), F.min(F.when(F.col("mag_type") == "md", F.col("mag"))).alias("MD")
    )
    e = _events(spark, sf_dir).join(m, "id", "left")
    missing = lambda c: F.coalesce(c, F.lit(-999.0)).alias(c) if isinstance(c, str) else c
    rows = e.select(
        F.col("id").alias("orid"), F.date_format(F.timestamp_micros("us"), "dd/MM/yyyy HH:mm:ss").alias("datetime"), "lat", "lon", F.col("dep").alias("depth"),
        missing("ML"), missing("MD"), F.col("phase_count").alias("nbmagML"), F.lit(1.0).alias("nbmagMD"), F.col("az_gap").alias("gap1"), "rms",
    )
    when = F.date_format(F.timestamp_micros("us"), "dd/MM/yyyy HH:mm:ss.SS")
    arrivals = _picks(spark, sf_dir).select(F.col("id").alias("orid"), F.split_part("code", F.lit("."), F.lit(2)).alias("sta"), "phase", when.alias("arrtime"))
    return bulletins.read_ldg(spark, _csv(rows, "ldg", sep=";", header=True), _csv(arrivals, "arrivals", sep=";", header=True))


_LDG = f"""{_EV}, lm AS (SELECT event_uid AS id, min(mag) FILTER (WHERE mag_type = 'ml') AS ml, min(mag) FILTER (WHERE mag_type = 'md') AS md FROM m GROUP BY 1),
l AS (SELECT ev.*, ml, md FROM ev JOIN lm USING (id) WHERE coalesce(ml, md) IS NOT NULL)"""


@query(f"""WITH {_LDG} SELECT id AS seq, us - us % 1000000 AS origin_us, lat, lon, dep, coalesce(ml, md) AS mag, CASE WHEN ml IS NULL THEN 'MD' ELSE 'ML' END AS mag_type,
  'LDG' AS mag_author, CASE WHEN ml IS NULL THEN 1e0 ELSE phase_count END AS phase_count, az_gap, rms FROM l""")
def ldg_events_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as the catalog table of a pair of tables and read again."""
    return _ldg(spark, sf_dir)[0].drop("file")


@query(f"""WITH {_LDG}, {_PK} SELECT id AS seq, '.' || split_part(code, '.', 2) AS code, substr(phase, 1, 1) AS phase, us - us % 10000 AS us,
  CASE upper(substr(phase, 1, 1)) WHEN 'P' THEN 5e-2 ELSE 1.5e-1 END AS err_s FROM pk SEMI JOIN l USING (id)""")
def ldg_picks_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The arrivals of the pair, those of events with a magnitude."""
    return _ldg(spark, sf_dir)[1].select("seq", "code", "phase", "us", "err_s")


def _gse2(spark: SparkSession, sf_dir: str, layout: bulletins.Gse2Layout) -> tuple[DataFrame, DataFrame]:
    when = F.timestamp_micros("us")
    text = lambda c, d: F.format_string(f"%.{d}f", c)
    head = _columns(
        c0=F.date_format(when, "yyyy/MM/dd"), c11=F.date_format(when, "HH:mm:ss.SS"), c30=text("rms", 2), c36=text("lat", 4), c45=text("lon", 4), c71=text("dep", 1),
        c89=text("phase_count", 0), c93=text("az_gap", 0),
    )
    own = _columns(c0=F.col("mag_type"), c7=text("mag", 1), c20=F.col("mag_author"))
    hour = _columns(
        c0=F.split_part("code", F.lit("."), F.lit(2)), c19=F.col("phase"), c28=F.date_format(when, "HH:mm:ss.SS"), c99=F.lit("m__"), c114=F.split_part("code", F.lit("."), F.lit(1)), c119=F.col("channel")
    )
    lines = _picks(spark, sf_dir).select("id", hour.alias("line")).groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))
    e = _events(spark, sf_dir).select("id", head.alias("head"), own.alias("own")).join(lines, "id", "left")
    rows = [F.lit("DATA_TYPE BULLETIN")] + [F.lit("")] * (layout.picks - 1)
    rows[layout.header], rows[layout.magnitude] = F.col("head"), F.col("own")
    block = F.concat_ws("\n", *rows, "lines", F.lit(""))
    return bulletins.read_gse2(spark, _text(e.select(block), "gse2"), layout)


def _gse2_sql(least: str) -> str:
    us = "us - us % 86400000000 + CASE WHEN hour(make_timestamp(us)) = 23 AND hour(make_timestamp(p_us)) = 0 THEN 86400000000 ELSE 0 END + (p_us % 86400000000) - p_us % 10000"
    return f"""WITH {_EV}, {_PK}, g AS (SELECT * FROM ev WHERE mag IS NOT NULL AND {_FIXED("mag", 1)} >= {least}),
gp AS (SELECT g.id, g.us, pk.us AS p_us, pk.code, pk.phase, pk.channel FROM g JOIN pk USING (id)), back AS (SELECT id, code, substr(phase, 1, 1) AS phase, {us} AS us, channel FROM gp)
SELECT 'event' AS kind, count(*) AS n, CAST(sum(us - us % 10000) AS HUGEINT) % 1000000007 AS times, {_FIXED("sum(lat)", 3)} AS lats, {_FIXED(f"sum({_FIXED('mag', 1)})", 3)} AS mags FROM g
UNION ALL SELECT phase || ' ' || code, count(*), CAST(sum(us) AS HUGEINT) % 1000000007, NULL, NULL FROM back GROUP BY phase, code"""


def _gse2_counts(events: DataFrame, rows: DataFrame) -> DataFrame:
    times = lambda c: (F.sum(F.col(c).cast("decimal(38,0)")) % 1_000_000_007).cast("bigint").alias("times")
    none = F.lit(None).cast("double")
    one = events.agg(F.count("*").alias("n"), times("origin_us"), fixed(F.sum("lat"), 3).alias("lats"), fixed(F.sum("mag"), 3).alias("mags")).select(F.lit("event").alias("kind"), "*")
    other = rows.groupBy(F.concat_ws(" ", "phase", "code").alias("kind")).agg(F.count("*").alias("n"), times("us"))
    return one.unionByName(other.select("*", none.alias("lats"), none.alias("mags")))


@query(_gse2_sql("0"))
def gse2_icgc_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and picks written as GSE2 text in one layout and read again: counts and sums of times by station and phase."""
    return _gse2_counts(*_gse2(spark, sf_dir, bulletins.ICGC))


@query(_gse2_sql("-99"))
def gse2_ign_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the other layout, without a least magnitude."""
    return _gse2_counts(*_gse2(spark, sf_dir, bulletins.IGN))


def _quakeml(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    iso = lambda us: F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    tag = lambda name, value: F.concat(F.lit(f"<{name}><value>"), value.cast("string"), F.lit(f"</value></{name}>"))
    leaf = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    m = picks.mags(spark, sf_dir).where("mag_type = 'mlv'").select(
        F.col("event_uid").alias("id"), "mag_id",
        F.concat(F.lit('<magnitude publicID="m'), "mag_id", F.lit('"><mag><value>'), F.col("mag").cast("string"), F.lit("</value><uncertainty>"), "mag_id",
                 F.lit("</uncertainty></mag><type>MLv</type><creationInfo><author>analyst</author><agencyID>"), "mag_author", F.lit("</agencyID></creationInfo></magnitude>")).alias("t"),
    )
    m = m.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("mag_id", "t"))), lambda x: x["t"]), "").alias("magnitudes"))
    p = _picks(spark, sf_dir).select("id", F.concat(
        F.lit("<pick>"), tag("time", iso(F.col("us"))), F.lit('<waveformID networkCode="'), F.split_part("code", F.lit("."), F.lit(1)), F.lit('" stationCode="'),
        F.split_part("code", F.lit("."), F.lit(2)), F.lit('" channelCode="'), "channel", F.lit('"/>'), leaf("phaseHint", F.col("phase")), F.lit("<evaluationMode>manual</evaluationMode></pick>"),
    ).alias("t"))
    p = p.groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("t")), "").alias("picks"))
    quality = F.concat_ws("", F.lit("<quality>"), leaf("associatedPhaseCount", F.col("phase_count")), leaf("azimuthalGap", F.col("az_gap")), leaf("standardError", F.col("rms")), F.lit("</quality>"))
    origin = F.concat_ws("", F.lit("<origin>"), tag("time", iso(F.col("us"))), tag("latitude", F.col("lat")), tag("longitude", F.col("lon")), tag("depth", F.col("dep") * 1000), quality, F.lit("</origin>"))
    e = _events(spark, sf_dir).join(m, "id", "left").join(p, "id", "left")
    text = F.concat_ws("", F.lit('<event publicID="E'), "id", F.lit('">'), origin, "magnitudes", "picks", F.lit("</event>"))
    # as many files as a shuffle has partitions, each with one root
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    root = F.explode(F.array(F.struct(F.lit(0).alias("place"), F.lit("<quakeml><eventParameters>").alias("t")), F.struct(F.lit(2).alias("place"), F.lit("</eventParameters></quakeml>").alias("t"))))
    ends = spark.range(n).select(F.col("id").alias("bucket"), root.alias("r")).select("bucket", "r.place", "r.t")
    lines = e.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("bucket"), F.lit(1).alias("place"), text.alias("t")).unionByName(ends)
    path = new_stage_path(spark, "quakeml")
    lines.repartition(n, "bucket").sortWithinPartitions("bucket", "place").drop("place").write.partitionBy("bucket").text(path)
    return bulletins.read_quakeml(spark, path)


_QML = f"""{_EV}, qm AS (SELECT event_uid AS id, arg_min(mag, mag_id) AS best, arg_min(mag_author, mag_id) AS author FROM m WHERE mag_type = 'mlv' GROUP BY 1),
q AS (SELECT ev.* EXCLUDE (mag, mag_type, mag_author), best AS mag, author AS mag_author FROM ev JOIN qm USING (id))"""


@query(f"""WITH {_QML} SELECT us AS origin_us, lat, lon, {_FIXED("dep", 3)} AS dep, mag, 'MLv' AS mag_type, mag_author, phase_count, az_gap, rms FROM q""")
def quakeml_events_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as QuakeML and read again, those with a magnitude of the kind, the one of least uncertainty."""
    return _quakeml(spark, sf_dir)[0].drop("file", "seq").withColumn("dep", fixed(F.col("dep"), 3))


@query(f"""WITH {_QML}, {_PK} SELECT code, substr(phase, 1, 1) AS phase, pk.us - pk.us % 1000 AS us, channel, count(*) AS n FROM pk SEMI JOIN q USING (id) GROUP BY ALL""")
def quakeml_picks_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manual picks of the same file, cut to milliseconds."""
    return _quakeml(spark, sf_dir)[1].groupBy("code", "phase", "us", "channel").agg(F.count("*").alias("n"))


# models


_SEGMENTS = picks._FIT.partition("SELECT f.mag_type")[0] + f""", w AS (SELECT f.mag_type, f.mag_author, slope, intercept, slope_low, slope * 2 + intercept - slope_low * 2 AS intercept_low FROM f LEFT JOIN p USING (mag_type, mag_author))
SELECT mag_type, mag_author, '>=2' AS seg, {_FIXED("slope", 4)} AS slope, {_FIXED("intercept", 4)} AS intercept FROM w
UNION ALL SELECT mag_type, mag_author, '<2', {_FIXED("slope_low", 4)}, {_FIXED("intercept_low", 4)} FROM w WHERE slope_low IS NOT NULL"""


@query(_SEGMENTS)
def models_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted models written as a table of models, a row a segment, and read again."""
    fits = statistics.two_piece_fits(picks._mag_pairs(spark, sf_dir), ["mag_type", "mag_author"]).where("n >= 10")
    path = _csv(statistics.model_rows(fits), "models", header=True)
    back = spark.read.csv(path, header=True, schema="mag_type string, mag_author string, seg string, slope double, intercept double")
    return back.select("mag_type", "mag_author", "seg", fixed(F.col("slope"), 4).alias("slope"), fixed(F.col("intercept"), 4).alias("intercept"))


# stations


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "station_site")


_OUT = "network, station, code, latitude, longitude, elevation, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us"


def _epochs(df: DataFrame, *more: str) -> DataFrame:
    ends = [F.unix_micros(f"{n}_ts").alias(f"{n}_us") for n in ("start", "end")]
    return df.select("network", "station", "code", "latitude", "longitude", "elevation", *ends, *more)


@query(f"SELECT {_OUT}, site_id AS alt_code FROM station_site")
def station_xml_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites written as StationXML and read again."""
    path = new_stage_path(spark, "stations")
    stations.write_station_xml(_sites(spark, sf_dir).withColumn("alt_code", F.col("site_id")), path)
    return _epochs(stations.read_station_xml(spark, path), "alt_code")


@query(f"SELECT {_OUT} FROM station_site")
def station_csv_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites written as a table and read again; an unknown elevation is 0."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    rows = _sites(spark, sf_dir).select("network", "station", "latitude", "longitude", F.when(F.col("elevation") != 0, F.col("elevation")).alias("elevation"), day("start_ts").alias("starttime"), day("end_ts").alias("endtime"))
    return _epochs(stations.read_station_csv(spark, _csv(rows, "stations", header=True)))


def _channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two channels a site, one at a default location, as separated text and read again."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    both = F.explode(F.array(F.struct(F.lit("00").alias("location"), F.lit("HHZ").alias("channel")), F.struct(F.lit("10").alias("location"), F.lit("LHZ").alias("channel"))))
    s = _sites(spark, sf_dir).select("*", both.alias("c"))
    empty = F.lit("")
    line = F.concat_ws("|", "network", "station", "c.location", "c.channel", F.col("latitude").cast("string"), F.col("longitude").cast("string"), F.col("elevation").cast("string"),
                       *[empty] * 7, F.lit("100.0"), F.coalesce(day("start_ts"), empty), F.coalesce(day("end_ts"), empty))
    return stations.read_station_text(spark, _text(s.select(line), "channels"))


@query("""SELECT network, station, l AS location, c AS channel, CASE WHEN l = '00' THEN 'HH' ELSE l END AS key, latitude, longitude, elevation, 100e0 AS rate, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us
FROM station_site, (VALUES ('00', 'HHZ'), ('10', 'LHZ')) v(l, c)""")
def station_text_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels written as separated text and read again, with the key of their location."""
    c = _channels(spark, sf_dir)
    key = stations.location_key(F.col("location"), F.col("channel")).alias("key")
    return c.select("network", "station", "location", "channel", key, "latitude", "longitude", "elevation", "rate", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"))


@query("""SELECT network, station, 'HHZ' AS channel, epoch_us(start_ts) AS start_us FROM station_site
WHERE latitude BETWEEN 42 AND 44 AND longitude BETWEEN -2 AND 3.5e0 AND epoch_us(start_ts) <= 1514764800000000 AND (end_ts IS NULL OR epoch_us(end_ts) >= 1517443200000000)""")
def usable_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels of the right sensors at the default location inside a box that run over January 2018."""
    start, end = F.timestamp_seconds(F.lit(1514764800)), F.timestamp_seconds(F.lit(1517443200))
    found = stations.usable_channels(_channels(spark, sf_dir), (42.0, 44.0, -2.0, 3.5), start, end)
    return found.select("network", "station", "channel", F.unix_micros("start_ts").alias("start_us"))


def _code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _sites(spark, sf_dir)
    rows = s.join(numbered_codes(s), "code").select("alt_code", "code", "start_ts", "end_ts", F.substring("site_id", 2, 9).cast("bigint").alias("ord"))
    path = new_stage_path(spark, "codes")
    stations.write_code_map(rows, path)
    return stations.read_code_map(spark, path)


_MAP = picks.SQL["alt_codes"]


@query(f"""SELECT alt_code, s.code, s.network, s.station AS sta, epoch_us(start_ts) AS start_us, epoch_us(end_ts) AS end_us FROM station_site s JOIN ({_MAP}) USING (code)""")
def code_map_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code map of all stations written in blocks and read again."""
    return _code_map(spark, sf_dir).select("alt_code", "code", "network", "sta", F.unix_micros("start_ts").alias("start_us"), F.unix_micros("end_ts").alias("end_us"))


_DELAYS = picks.SQL["station_delays"]


def _delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = picks.station_delays(spark, sf_dir)
    line = F.format_string("LOCDELAY %s %s %d %.4f %.4f", "code", "letter", "n", "mean", "std")
    return relocation.read_delays(spark, _text(d.select(line), "delays"))


@query(f"SELECT code AS sta, letter AS phase, CAST(n AS INTEGER) AS n, mean AS correction, std FROM ({_DELAYS}) WHERE n >= 30 AND std >= 0")
def delays_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station delays written as lines of a run file and read again, those of at least 30 readings."""
    return relocation.usable_delays(_delays(spark, sf_dir), 30)


@query(f"""WITH d AS (SELECT code, letter, n, mean FROM ({_DELAYS}) WHERE abs(mean) > 3e-1), c AS (SELECT DISTINCT alt_code, code FROM station_site JOIN ({_MAP}) USING (code))
SELECT d.code AS sta, letter AS phase, mean AS correction, alt_code, c.code IS NULL AS missing FROM d LEFT JOIN c USING (code)""")
def delays_on_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays beyond 0.3 s with the code map's block of their station, or flagged as missing there."""
    d = _delays(spark, sf_dir).where(F.abs("correction") > 0.3)
    return delays_by_station(d, _code_map(spark, sf_dir)).select("sta", "phase", "correction", "alt_code", "missing")


@query(f"""WITH g AS ({picks.SQL["gtsrce"]}), t AS (SELECT string_split(line, ' ') AS t FROM g)
SELECT t[2] AS code, t[4]::DOUBLE AS latitude, t[5]::DOUBLE AS longitude, {_FIXED("t[7]::DOUBLE * 1000", 3)} AS elevation FROM t""")
def gtsrce_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station lines of a travel-time program read again."""
    lines = picks.gtsrce(spark, sf_dir)
    return stations.read_gtsrce(spark, _text(lines.unionByName(lines), "gtsrce")).withColumn("elevation", fixed(F.col("elevation"), 3))


@query("SELECT site_id AS code, latitude, longitude, elevation / 1000 AS depth FROM station_site")
def last_stations_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A program's list of used stations."""
    zero = F.lit(0.0)
    rows = _sites(spark, sf_dir).select("site_id", zero.alias("x"), zero.alias("y"), zero.alias("z"), "latitude", "longitude", F.col("elevation") / 1000)
    return stations.read_last_stations(spark, _csv(rows, "last", sep=" "))


# relocation


@query("""SELECT 'zone=' || l_linenumber AS zone, CAST(l_orderkey AS VARCHAR) AS public_id, l_quantity::DOUBLE AS lat, l_extendedprice::DOUBLE AS pdf_volume, l_tax::DOUBLE AS rms, count(*) AS n
FROM lineitem GROUP BY ALL""")
def solutions_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relocation solutions written as one table a zone and read again."""
    names = ["longitude", "depth", "EllipsoidAz1", "EllipsoidDip1", "EllipsoidLen1", "EllipsoidAz2", "EllipsoidDip2", "EllipsoidLen2", "EllipsoidLen3", "Nphs", "Gap"]
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("zone"), F.col("l_orderkey").alias("publicId"), F.lit("2020-01-01").alias("date-time"), F.col("l_quantity").cast("double").alias("latitude"),
        F.col("l_extendedprice").cast("double").alias("pdfVolume"), F.col("l_tax").cast("double").alias("RMS"), *[F.lit(1.0).alias(n) for n in names],
    )
    path = new_stage_path(spark, "solutions")
    rows.write.partitionBy("zone").csv(path, header=True)
    return relocation.read_solutions(spark, path).groupBy("zone", "public_id", "lat", "pdf_volume", "rms").agg(F.count("*").alias("n"))


@query(f"SELECT 'zone_id=' || zone_id AS zone, {_FIXED('lat_sw', 2)} AS lat_sw, {_FIXED('lon_sw', 2)} AS lon_sw, CAST(nx AS INTEGER) AS nx, CAST(ny AS INTEGER) AS ny FROM ({catalog.SQL['grid_corners']})")
def run_files_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run file of each zone, and what is read from it again."""
    zones = catalog.grid_corners(spark, sf_dir).select("zone_id", fixed(F.col("lat_sw"), 2).alias("lat_sw"), fixed(F.col("lon_sw"), 2).alias("lon_sw"), "nx", "ny",
                                                       *[F.lit(f"./{n}").alias(n) for n in ("model", "times", "bulletin", "out", "stations")])
    path = new_stage_path(spark, "runs")
    relocation.run_file(zones).write.partitionBy("zone_id").text(path)
    return relocation.read_run_files(spark, path).select(F.regexp_extract("file", "(zone_id=[^/]+)/", 1).alias("zone"), "lat_sw", "lon_sw", "nx", "ny")


_POSITIVE = "lat BETWEEN 0 AND 89 AND lon BETWEEN 0 AND 179 AND dep IS NOT NULL AND mag BETWEEN 0 AND 9.9e0"


@query(f"WITH {_EV} SELECT us - us % 10000 AS origin_us, lat, lon, dep, mag, erh, count(*) AS n FROM ev GROUP BY ALL")
def relocated_text_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lists of fifteen columns with two-digit years, read again."""
    us = _down(F.col("us"), 10_000)
    when = F.timestamp_micros(us)
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = F.concat_ws(" ", F.date_format(when, "yy MM dd HH mm"), F.date_format(when, "ss.SS"), *[number(c) for c in ("lat", "lon", "dep", "mag", "rms", "phase_count", "erh", "erv", "az_gap")])
    back = relocation.read_relocated_text(spark, _text(_events(spark, sf_dir).select(line), "relocated"))
    return back.groupBy("origin_us", "lat", "lon", "dep", "mag", "erh").agg(F.count("*").alias("n"))


_MINUTES = lambda c: f"floor({c}) + floor(({c} - floor({c})) * 6000 + 5e-1) / 1e2 / 60"


@query(f"""WITH {_EV} SELECT CAST(hour(make_timestamp(us)) AS INTEGER) AS hour, CAST(minute(make_timestamp(us)) AS INTEGER) AS minute, (us % 60000000 - us % 10000) / 1e6 AS second,
  {_FIXED("(" + _MINUTES("lat") + ")", 6)} AS lat, {_FIXED("(" + _MINUTES("lon") + ")", 6)} AS lon, dep, {_FIXED("mag", 1)} AS mag, count(*) AS n FROM ev WHERE {_POSITIVE} GROUP BY ALL""")
def hypo71_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as fixed-width summaries in degrees and minutes, read again."""
    when = F.timestamp_micros("us")
    degrees = lambda c: F.format_string("%.0f", F.floor(c).cast("double"))
    minutes = lambda c: F.format_string("%.2f", F.floor((F.col(c) - F.floor(c)) * 6000 + 0.5) / 100)
    line = _columns(
        c1=F.date_format(when, "yyMMdd"), c8=F.date_format(when, "HHmm"), c12=F.date_format(when, "ss.SS"), c18=degrees("lat"), c21=minutes("lat"), c28=degrees("lon"), c31=minutes("lon"),
        c38=F.col("dep"), c47=fixed(F.col("mag"), 1),
    )
    e = _events(spark, sf_dir).where(_POSITIVE.replace("9.9e0", "9.9"))
    back = relocation.read_hypo71(spark, _text(e.select(line), "hypo71"))
    return back.select("hour", "minute", "second", fixed(F.col("lat")).alias("lat"), fixed(F.col("lon")).alias("lon"), "dep", "mag").groupBy("hour", "minute", "second", "lat", "lon", "dep", "mag").agg(F.count("*").alias("n"))


# external picks


def _temporary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return picks._temporary(spark, sf_dir).where("code <> ''")


_TEMP = f"WITH {picks._T}, x AS (SELECT pick, split_part(code, '.', 2) AS sta, letter AS phase, us, CASE letter WHEN 'P' THEN 5e-2 ELSE 1.5e-1 END AS err_s FROM t WHERE code <> '')"
_ISO = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def _same(back: DataFrame) -> DataFrame:
    return back.groupBy("sta", "phase", "us", "err_s", "origin").agg(F.count("*").alias("n"))


@query(_TEMP + " SELECT sta, phase, us, err_s, 'TEMP_RSB' AS origin, count(*) AS n FROM x GROUP BY ALL")
def detector_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporary picks as a detector's lines, read again."""
    when = F.coalesce(F.date_format(F.timestamp_micros("us"), _ISO), F.lit("None"))
    line = F.concat_ws(" ", F.concat("code", F.lit(".00")), "letter", when, F.lit("prob=0.9"))
    return _same(external_picks.read_picks(spark, _text(_temporary(spark, sf_dir).select(line), "detector"), "TEMP_RSB"))


@query(_TEMP + " SELECT sta, phase, us, err_s, 'TEMP_OMP' AS origin, count(*) AS n FROM x GROUP BY ALL")
def detector_csv_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporary picks as a tree of tables, one folder a station, read again."""
    e = F.lit(None).cast("string")
    rows = _temporary(spark, sf_dir).select(
        F.lit("f").alias("file_name"), e.alias("begin_time"), F.concat("code", F.lit(".00")).alias("station_id"), e.alias("phase_index"),
        F.date_format(F.timestamp_micros("us"), _ISO).alias("phase_time"), e.alias("phase_score"), e.alias("phase_ampl"), F.col("letter").alias("phase_type"), F.col("letter").alias("folder"),
    )
    path = new_stage_path(spark, "detector")
    rows.write.partitionBy("folder").csv(path, header=True)
    return _same(external_picks.read_picks(spark, path, "TEMP_OMP"))


@query(_TEMP + " SELECT sta, phase, us - us % 1000 AS us, err_s, 'TEMP_OBS' AS origin, count(*) AS n FROM x WHERE us IS NOT NULL GROUP BY ALL")
def temp_obs_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporary picks as pick lines, read again."""
    none = F.lit(None).cast("string")
    error = F.when(F.col("letter") == "P", 0.05).otherwise(0.15)
    line = obs.pick_line(_down(F.col("us"), 1000), code=F.split_part("code", F.lit("."), F.lit(2)), phase=F.col("letter"), err_s=error, channel=none, origin=none)
    return _same(external_picks.read_picks(spark, _text(_temporary(spark, sf_dir).where("us IS NOT NULL").select(line), "temp"), "TEMP_OBS"))


@query("SELECT CAST(temp_id AS VARCHAR) || ' ' || code AS value, count(*) AS n FROM temp_pick GROUP BY ALL")
def joined_text_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All text files of a folder as one."""
    lines = table(spark, sf_dir, "temp_pick").select(F.concat_ws(" ", F.col("temp_id").cast("string"), "code"))
    return external_picks.joined_text(spark, _text(lines, "folder")).groupBy("value").agg(F.count("*").alias("n"))


@query(f"SELECT distance, tp_low, tp_high, ts_low, ts_high, k FROM ({picks.SQL['tt_envelope']})")
def tt_csv_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The travel-time table written and read again."""
    rows = picks.tt_envelope(spark, sf_dir).select("distance", "tp_low", "tp_high", "ts_low", "ts_high")
    return external_picks.read_travel_times(spark, _csv(rows, "times", header=True))

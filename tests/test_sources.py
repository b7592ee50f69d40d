"""Readers and writers on small texts written for the purpose."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quakeloom.sources import bulletins, external_picks, obs, relocation, stations

T0 = dt.datetime(2020, 1, 2, tzinfo=dt.UTC)


def _us(hour=0, minute=0, second=0.0, day=0):
    return round((T0 + dt.timedelta(days=day, hours=hour, minutes=minute, seconds=second)).timestamp() * 1e6)


def _line(width, **at):
    """A line with texts at columns: c12="x"."""
    s = [" "] * width
    for k, text in at.items():
        s[int(k[1:]) : int(k[1:]) + len(text)] = text
    return "".join(s)


def test_obs_round_trip(spark, tmp_path):
    text = (
        "### Catalog\n### Columns\n\n"
        "# 2020 1 2 3 4 5.25 42.91 -0.65 8.0 1.70 ML LDG 6.0 None None 120.0 0.21\nPUBLIC_ID EVENT_000001\n"
        "FR.0001   ?    ?    ? P      ? 20200102 0304 07.100 GAU 0.05      -1.00e+00 -1.00e+00 -1.00e+00 # Pg     None LDG       None\n\n"
        "# 2020 1 2 4 0 59.9999 42.0 1.0 None None None None None None None None None\n\n"
        "# too few tokens\n"
    )
    (tmp_path / "a.obs").write_text(text)
    events = obs.read_events(spark, str(tmp_path / "a.obs")).orderBy("seq").collect()
    assert [(e.origin_us, e.lat, e.dep, e.mag, e.mag_type, e.erh, e.public_id) for e in events] == [
        (_us(3, 4, 5.25), 42.91, 8.0, 1.7, "ML", None, "EVENT_000001"),
        (_us(4, 0, 59.9999), 42.0, None, None, None, None, None),
        (None, None, None, None, None, None, None),
    ]
    picks = obs.read_picks(spark, str(tmp_path / "a.obs"))
    p = picks.first()
    assert (p.code, p.phase, p.us, p.err_s, p.coda, p.real_phase, p.origin, p.pick_seq) == ("FR.0001", "P", _us(3, 4, 7.1), 0.05, -1.0, "Pg", "LDG", 1)

    good = obs.read_events(spark, str(tmp_path / "a.obs")).where("origin_us IS NOT NULL")
    fields = ["lat", "lon", "dep", "mag", "mag_type", "mag_author", "phase_count", "erh", "erv", "az_gap", "rms"]
    head = good.select("seq", "public_id", obs.header_line(F.col("origin_us"), **{f: F.col(f) for f in fields}).alias("header"))
    lines = picks.select("seq", "pick_seq", obs.pick_line(F.col("us"), **{f: F.col(f) for f in ("code", "phase", "err_s", "channel", "origin")}).alias("line"))
    obs.write(head, lines, str(tmp_path / "out"))
    again = obs.read_events(spark, str(tmp_path / "out")).orderBy("origin_us").collect()
    assert [(e.lat, e.mag, e.public_id) for e in again] == [(42.91, 1.7, "EVENT_000001"), (42.0, None, None)]
    q = obs.read_picks(spark, str(tmp_path / "out")).first()
    assert (q.code, q.phase, q.us, q.err_s) == (p.code, p.phase, p.us, p.err_s)


@pytest.mark.parametrize("gap", ["\n", " \n", "\t\n\n", ""])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_obs_blocks_begin_at_headers(spark, tmp_path, gap, end):
    """Blank lines of any kind, or none, and both line ends: three events, each with its own picks."""
    pick = "FR.000%d   ?    ?    ? P      ? 20200102 0304 07.100 GAU 0.05      -1.00e+00 -1.00e+00 -1.00e+00 # Pg     None LDG       None\n"
    blocks = [f"# 2020 1 2 {h} 4 5.25 42.91 -0.65 8.0 1.70 ML LDG 6.0 None None 120.0 0.21\nPUBLIC_ID E{h}\n" + "".join(pick % k for k in range(h)) for h in (1, 2, 3)]
    text = "### Catalog\n" + gap + gap.join(blocks)
    (tmp_path / "a.obs").write_bytes(text.replace("\n", end).encode())
    (tmp_path / "b.obs").write_bytes(blocks[1].encode())
    path = str(tmp_path / "*.obs")
    events = {(e.file[-5:], e.seq): e for e in obs.read_events(spark, path).collect()}
    assert {k: (e.public_id, e.origin_us) for k, e in events.items()} == {
        ("a.obs", 1): ("E1", _us(1, 4, 5.25)), ("a.obs", 2): ("E2", _us(2, 4, 5.25)), ("a.obs", 3): ("E3", _us(3, 4, 5.25)), ("b.obs", 1): ("E2", _us(2, 4, 5.25)),
    }
    picks = sorted((p.file[-5:], p.seq, p.pick_seq, p.code) for p in obs.read_picks(spark, path).collect())
    assert picks == [("a.obs", h, k + 1, f"FR.000{k}") for h in (1, 2, 3) for k in range(h)] + [("b.obs", 1, k + 1, f"FR.000{k}") for k in range(2)]


def test_obs_keys_over_splits(spark, tmp_path):
    """A file in many splits: events and picks still have one key, in the order of the file."""
    lines = []
    for i in range(400):
        lines.append(f"# 2020 1 2 {i % 24} 4 5.25 42.91 -0.65 8.0 1.70 ML LDG {i} None None 120.0 0.21")
        lines += [f"XX.{i:04}   ?    ?    ? P      ? 20200102 0304 07.100 GAU 0.05      -1.00e+00 -1.00e+00 -1.00e+00 # Pg     None LDG       None"] * (i % 3)
    (tmp_path / "a.obs").write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        events = {e.seq: int(e.phase_count) for e in obs.read_events(spark, str(tmp_path)).collect()}
        picks = [(p.seq, p.code, p.pick_seq) for p in obs.read_picks(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert events == {i + 1: i for i in range(400)}
    assert sorted(picks) == [(i + 1, f"XX.{i:04}", k + 1) for i in range(400) for k in range(i % 3)]


def _gse2_pick(station, phase, time, flag="m__"):
    return _line(125, c0=station, c19=phase, c28=time, c99=flag, c114="CA", c119="HHZ")


@pytest.mark.parametrize("layout", [bulletins.ICGC, bulletins.IGN])
def test_gse2(spark, tmp_path, layout):
    def block(mag, picks):
        lines = ["DATA_TYPE BULLETIN"] + [""] * (layout.picks - 1)
        lines[layout.header] = _line(100, c0="2020/01/31 23:59:58.10", c30="0.21", c36="42.5000", c45="1.2500", c71="8.0", c89="12", c93="120")
        lines[layout.magnitude] = _line(30, c0="ML", c7=mag, c20="ICGC")
        return "\n".join(lines + picks) + "\n\n"

    picks = [_gse2_pick("ABC", "Pg", "23:59:59.500"), _gse2_pick("DEF", "Sn", "00:00:05.25"), _gse2_pick("GHI", "Pg", "23:59:59.000", "a__"), _gse2_pick("JKL", "Lg", "23:59:59.000")]
    (tmp_path / "g.txt").write_text("HEAD\n" + block("1.5", picks) + block("   ", picks))
    events, rows = bulletins.read_gse2(spark, str(tmp_path / "g.txt"), layout)
    e = events.collect()
    assert len(e) == 1 and (e[0].lat, e[0].lon, e[0].dep, e[0].mag, e[0].mag_type, e[0].mag_author) == (42.5, 1.25, 8.0, 1.5, "ML", "ICGC")
    assert e[0].origin_us == _us(23, 59, 58.1, day=29)
    got = [(p.pick_seq, p.code, p.phase, p.us, p.err_s, p.channel) for p in rows.orderBy("pick_seq").collect()]
    assert got == [(1, "CA.ABC", "P", _us(23, 59, 59.5, day=29), 0.05, "HHZ"), (2, "CA.DEF", "S", _us(0, 0, 5.25, day=30), 0.15, "HHZ")]


def test_omp(spark, tmp_path):
    def block(year="120", mag="1.5", sec=" 5.50", hour=" 3", picks=()):
        lines = [" Localisation", "", _line(40, c35="W"), "", _line(60, c0=year, c3=" 1", c5=" 2", c8=hour, c10=" 4", c13=sec, c19="42", c22="30.00", c29=" 1", c32="15.00", c39="  8.0", c45=" 0.21", c51=mag), "", ""]
        return "\n".join([*lines, *picks]) + "\n\n"

    pick = lambda sta, qp, p, qs=" ", s="": _line(112, c1=sta, c23=qp, c25=" 3", c27=" 4", c30=p, c102=qs, c105=s)
    picks = [pick("AAA", "0", " 7.05", "1", " 9.5"), pick("BBB", "4", " 7.00"), pick("LARF", "0", " 8.00"), pick("CCC", "2", "-1.00"), pick("DDD", "0", " *** "), pick("EEE", "9", " 8.00", "0")]
    (tmp_path / "o.mag").write_text("x\n" + block(year="020", picks=picks) + block(year="020", mag="9.9") + block(year="020", mag=" -6") + block(year="020", sec="60.00", hour="24"))
    events, rows = bulletins.read_omp(spark, str(tmp_path / "o.mag"))
    e = events.orderBy("seq").collect()
    assert [(x.origin_us, x.lat, x.lon, x.mag) for x in e] == [(_us(3, 4, 5.5), 42.5, -1.25, 1.5), (_us(23, 5, 0), 42.5, -1.25, 1.5)]
    got = [(p.code, p.phase, p.us, p.ins, p.err_s) for p in rows.orderBy("pick_seq").collect()]
    assert got == [(".AAA", "P", _us(3, 4, 7.05), "?", 0.05), (".AAA", "S", _us(3, 4, 9.5), "?", 0.05), (".LARF", "P", _us(3, 4, 8), "*", 0.05), (".CCC", "P", _us(3, 3, 59), "?", 0.10)]


def test_ldg(spark, tmp_path):
    (tmp_path / "c.csv").write_text("orid;datetime;lat;lon;depth;ML;MD;nbmagML;nbmagMD;gap1;rms\n1;02/01/2020 03:04:05.9;42.5;1.0;8;1.5;-999;6;0;120;0.2\n2;02/01/2020 04:00:00;42.5;1.0;8;-999;2.5;0;4;120;0.2\n3;02/01/2020 05:00:00;42.5;1.0;8;-999;-999;0;0;120;0.2\n")
    (tmp_path / "a.csv").write_text("orid;sta;phase;arrtime\n1;ABC;Pg;02/01/2020 03:04:07.12\n1;ABC;Lg;02/01/2020 03:04:09\n3;ABC;P;02/01/2020 03:04:09\n")
    events, picks = bulletins.read_ldg(spark, str(tmp_path / "c.csv"), str(tmp_path / "a.csv"))
    got = [(e.seq, e.origin_us, e.mag, e.mag_type, e.phase_count) for e in events.orderBy("seq").collect()]
    assert got == [(1, _us(3, 4, 5), 1.5, "ML", 6.0), (2, _us(4), 2.5, "MD", 4.0)]
    assert [(p.seq, p.code, p.phase, p.us) for p in picks.collect()] == [(1, ".ABC", "P", _us(3, 4, 7.12))]


def _magnitude(i, kind="MLv", mag=1.0, unc=None, author="hand", status=""):
    u = f"<uncertainty>{unc}</uncertainty>" if unc is not None else ""
    return f'<magnitude publicID="m{i}"><type>{kind}</type><evaluationStatus>{status}</evaluationStatus><mag><value>{mag}</value>{u}</mag><creationInfo><author>{author}</author><agencyID>RESIF</agencyID></creationInfo></magnitude>'


@pytest.mark.parametrize(
    "preferred, magnitudes, want",
    [
        ("m1", [_magnitude(1, mag=2.5), _magnitude(2, mag=1.5, unc=0.1)], 2.5),
        ("m1", [_magnitude(1, mag=2.5, author="scautomag"), _magnitude(2, mag=1.5, unc=0.3), _magnitude(3, mag=1.7, unc=0.1)], 1.7),
        ("m1", [_magnitude(1, kind="Mw", mag=2.5), _magnitude(2, mag=1.5)], 1.5),
        ("m9", [_magnitude(1, mag=2.5), _magnitude(2, mag=1.5)], None),
        ("m9", [_magnitude(1, mag=2.5, author="auto", status="confirmed"), _magnitude(2, mag=1.5, author="auto", status="confirmed")], 1.5),
        ("m9", [_magnitude(1, kind="Mw")], None),
    ],
)
def test_quakeml(spark, tmp_path, preferred, magnitudes, want):
    pick = lambda phase, mode: f'<pick publicID="p"><time><value>2020-01-02T03:04:07.123900Z</value></time><waveformID networkCode="FR" stationCode="ABC" channelCode="HHZ"/><phaseHint>{phase}</phaseHint><evaluationMode>{mode}</evaluationMode></pick>'
    origin = "<origin><time><value>2020-01-02T03:04:05.5Z</value></time><latitude><value>42.5</value></latitude><longitude><value>1.0</value></longitude><depth><value>8000</value></depth><quality><azimuthalGap>120</azimuthalGap></quality></origin>"
    body = f'<event publicID="e1"><preferredMagnitudeID>{preferred}</preferredMagnitudeID>{origin}{"".join(magnitudes)}{pick("Pn", "manual")}{pick("P", "automatic")}{pick("Lg", "manual")}</event>'
    (tmp_path / "q.xml").write_text(f"<q:quakeml xmlns:q='x'><eventParameters>{body}</eventParameters></q:quakeml>")
    events, picks = bulletins.read_quakeml(spark, str(tmp_path / "q.xml"))
    got = [(e.origin_us, e.dep, e.mag, e.mag_author, e.az_gap) for e in events.collect()]
    assert got == ([(_us(3, 4, 5.5), 8.0, want, "RESIF", 120.0)] if want else [])
    if want:
        assert [(p.code, p.phase, p.us, p.channel) for p in picks.collect()] == [("FR.ABC", "P", _us(3, 4, 7.123), "HHZ")]


def test_station_xml_round_trip(spark, tmp_path):
    sites = spark.createDataFrame([("FR", "ABC", "FR.0001", 42.5, 1.0, 800.0, T0, None), ("FR", "DEF", "FR.0002", 42.6, 1.1, 0.0, T0, T0)], "network string, station string, alt_code string, latitude double, longitude double, elevation double, start_ts timestamp, end_ts timestamp")
    stations.write_station_xml(sites, str(tmp_path / "x"))
    got = [(r.code, r.alt_code, r.latitude, r.elevation, r.end_ts is None) for r in stations.read_station_xml(spark, str(tmp_path / "x")).orderBy("code").collect()]
    assert got == [("FR.ABC", "FR.0001", 42.5, 800.0, True), ("FR.DEF", "FR.0002", 42.6, 0.0, False)]


def test_station_texts(spark, tmp_path):
    (tmp_path / "s.csv").write_text("network,station,latitude,longitude,elevation,starttime,endtime\nXX,ABC,42.5,1.0,,2020:01:02T00:00:00,\n")
    s = stations.read_station_csv(spark, str(tmp_path / "s.csv")).first()
    assert (s.code, s.elevation, s.start_ts, s.end_ts) == ("XX.ABC", 0.0, T0.replace(tzinfo=None), None)
    row = "FR|ABC|{}|{}|42.5|1.0|800|0|0|0|x|1|1|m|100|2020-01-01T00:00:00|{}\n"
    (tmp_path / "f.txt").write_text("#head\n" + row.format("00", "HHZ", "") + row.format("10", "HHZ", "") + row.format("", "LHZ", "") + row.format("", "EHZ", "2020-01-02T00:00:00"))
    c = stations.read_station_text(spark, str(tmp_path / "f.txt"))
    assert c.count() == 4
    got = stations.usable_channels(c, (42.0, 43.0, 0.0, 2.0), T0, T0 + dt.timedelta(hours=12)).collect()
    assert [(r.location, r.channel) for r in got] == [("00", "HHZ")]


def test_code_map_round_trip(spark, tmp_path):
    text = "Alternate Code: FR.0001\nStation Code: FR.ABC\nStart Date: 2020-01-02T00:00:00.000000Z\nEnd Date: None\nStation Code: RA.ABC\nStart Date: None\nEnd Date: None\n\nAlternate Code: FR.0002\nStation Code: FR.DEF\nStart Date: None\nEnd Date: 2020-01-02T00:00:00.000000Z\n"
    (tmp_path / "m.txt").write_text(text)
    rows = stations.read_code_map(spark, str(tmp_path / "m.txt"))
    key = lambda r: (r.alt_code, r.code, r.sta, r.start_ts, r.end_ts)
    t = T0.replace(tzinfo=None)
    want = [("FR.0001", "FR.ABC", "ABC", t, None), ("FR.0001", "RA.ABC", "ABC", None, None), ("FR.0002", "FR.DEF", "DEF", None, t)]
    assert [key(r) for r in rows.orderBy("ord").collect()] == want
    stations.write_code_map(rows, str(tmp_path / "w"))
    assert [key(r) for r in stations.read_code_map(spark, str(tmp_path / "w")).orderBy("ord").collect()] == want


def test_relocation_files(spark, tmp_path):
    zone = tmp_path / "GLOBAL_1"
    zone.mkdir()
    names = "publicId, date-time, latitude, longitude, depth, pdfVolume, EllipsoidAz1, EllipsoidDip1, EllipsoidLen1, EllipsoidAz2, EllipsoidDip2, EllipsoidLen2, EllipsoidLen3, Nphs, Gap, RMS"
    (zone / "r.csv").write_text(names + "\n" + "E1, 2020-01-02T03:04:05, 42.5, 1.0, 8.0, 3.5, 1, 2, 3, 4, 5, 6, 7, 8, 9, 0.1\n")
    r = relocation.read_solutions(spark, str(tmp_path / "GLOBAL_*")).first()
    assert (r.zone, r.public_id, r.lat, r.pdf_volume, r.len3, r.rms) == ("GLOBAL_1", "E1", 42.5, 3.5, 7.0, 0.1)
    (tmp_path / "d.txt").write_text("x\nLOCDELAY ABC P 120 0.5 0.2\nLOCDELAY ABC S 20 0.5 0.2\n")
    assert [(d.sta, d.phase, d.n) for d in relocation.usable_delays(relocation.read_delays(spark, str(tmp_path / "d.txt"))).collect()] == [("ABC", "P", 120)]
    zones = spark.createDataFrame([("1", 41.6, -3.2, 5000, 6000, "m", "t", "b", "o", "s")], "zone_id string, lat_sw double, lon_sw double, nx int, ny int, model string, times string, bulletin string, out string, stations string")
    relocation.run_file(zones).select("value").write.text(str(tmp_path / "run"))
    got = relocation.read_run_files(spark, str(tmp_path / "run")).first()
    assert (got.lat_sw, got.lon_sw, got.nx, got.ny) == (41.6, -3.2, 5000, 6000)
    (tmp_path / "l.txt").write_text("20 1 2 3 4 5.25 42.5 1.0 8.0 1.5 0.1 9 0.5 0.6 120\n77 1 2 3 4 5 42.5 1.0 8.0 1.5 0.1 9 0.5 0.6 120\n")
    assert [e.year for e in relocation.read_event_list(spark, str(tmp_path / "l.txt"), 1).collect()] == [2020, 1977]
    assert relocation.read_relocated_text(spark, str(tmp_path / "l.txt")).orderBy("year").first().origin_us == _us(3, 4, 5.25)
    assert relocation.read_event_list(spark, str(tmp_path / "l.txt"), 2).first().erh == pytest.approx(2.99)
    assert relocation.read_event_list(spark, str(tmp_path / "l.txt"), 5).first().rms == -1.0


def test_hypo71(spark, tmp_path):
    good = _line(80, c1=" 20102", c7=" 304 ", c12=" 5.25 ", c18="42 ", c21="30.00 ", c27="  1 ", c31="15.00  ", c38="  8.00 ", c47=" 1.5", c52="  9", c55=" 10", c58=" 120", c62=" 1", c64=" 0.21", c70=" 0.5", c75=" 0.6")
    vague = good[:52] + "***" + good[55:]
    (tmp_path / "h.txt").write_text("head\nhead\n" + good + "\n" + vague + "\n" + good[:18] + "xxx" + good[21:] + "\n")
    rows = relocation.read_hypo71(spark, str(tmp_path / "h.txt")).collect()
    assert [(r.year, r.month, r.day, r.hour, r.minute, r.lat, r.lon, r.erh) for r in rows] == [(2, 1, 2, 3, 4, 42.5, 1.25, 0.5), (2, 1, 2, 3, 4, 42.5, 1.25, None)]


def test_external_picks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ABC ? ? ? P ? 20200102 0304 07.1000 GAU 0.05e+00 -1.00e+00 -1.00e+00 -1.00e+00\nshort\n")
    (tmp_path / "b.txt").write_text("AM.R1234.00 P 2020-01-02T03:04:07.100000 prob=0.9\nAM.R1234.00 S 2020-01-02T03:04:09 prob=0.8\nR1 P x prob=1\n")
    year = tmp_path / "picks_2020_x"
    year.mkdir()
    (year / "PICKS_ARBS.csv").write_text("file_name,begin_time,station_id,phase_index,phase_time,phase_score,phase_ampl,phase_type\nf,t,CA.ARBS.00.HHX,1,2020-01-02T03:04:07.1,0.9,1,P\n")
    a = external_picks.read_picks(spark, str(tmp_path / "a.txt"), "TEMP_OBS").collect()
    assert [(p.sta, p.phase, p.us, p.err_s) for p in a] == [("ABC", "P", _us(3, 4, 7.1), 0.05)]
    b = external_picks.read_picks(spark, str(tmp_path / "b.txt"), "TEMP_RSB").orderBy("ord").collect()
    assert [(p.sta, p.phase, p.us, p.err_s) for p in b] == [("R1234", "P", _us(3, 4, 7.1), 0.05), ("R1234", "S", _us(3, 4, 9), 0.15)]
    c = external_picks.read_picks(spark, str(tmp_path), "TEMP_OMP")
    assert [(p.sta, p.phase, p.us) for p in c.collect()] == [("ARBS", "P", _us(3, 4, 7.1))]
    assert external_picks.without(c, ["ARBS"], []).count() == 0 and external_picks.without(c, ["SMC"], ["2020"]).count() == 0
    assert external_picks.joined_text(spark, str(tmp_path)).count() == 5 and external_picks.joined_text(spark, str(tmp_path / "none")).count() == 0


def test_envelope(spark):
    rows = [(m, d, 0.0, t, 2 * t) for m, d, t in (("min", 0, 1.0), ("plu", 0, 0.8), ("min", 30, 5.0), ("plu", 30, 4.0), ("ref", 0, 99.0))] + [("min", 0, 1.0, None, 1.0), ("plu", 0, 1.0, 2.0, 3.0)]
    e = {r.distance: r for r in external_picks.envelope(spark.createDataFrame(rows, "model string, depth int, distance double, tp double, ts double")).collect()}
    assert (e[0.0].tp_low, e[0.0].tp_high, e[0.0].ts_low) == (0.8, 4.0, 1.6)
    assert e[1.0].tp_low is None and (e[1.0].ts_low, e[1.0].ts_high) == (1.0, 3.0)

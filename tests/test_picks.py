import datetime as dt

from quakeloom.operators import bands, inventory, picklists

SITES = "code string, site_id string, network string, latitude double, longitude double, elevation double, start_ts timestamp, end_ts timestamp"
DAY = 86_400_000_000


def _sites(spark, rows):
    day = lambda d: dt.datetime(1970, 1, 1) + dt.timedelta(days=d) if d is not None else None
    return spark.createDataFrame([(c, s, c.split(".")[0], la, lo, e, day(a), day(b)) for c, s, la, lo, e, a, b in rows], SITES)


def test_validity_rules(spark):
    sites = _sites(spark, [("A.X", "S1", 0.0, 0.0, 0.0, 10, 20), ("A.Y", "S2", 0.0, 0.0, 0.0, 0, 10), ("A.Y", "S3", 0.0, 0.0, 0.0, 10, None), ("A.Z", "S4", 0.0, 0.0, 0.0, None, None), ("A.Z", "S5", 0.0, 0.0, 0.0, 5, 6)])
    picks = spark.createDataFrame([(1, "A.X", 99 * DAY), (2, "A.Y", 5 * DAY), (3, "A.Y", 10 * DAY), (4, "A.Y", 50 * DAY), (5, "A.Z", 5 * DAY), (6, "A.Z", 50 * DAY), (7, "N.O", DAY), (8, "A.Y", None)], "pick bigint, code string, us bigint")
    pairs = lambda df: dict(tuple(r)[:2] for r in df.collect())
    assert pairs(bands.remapped(picks, sites, "pick")) == {1: "S1", 2: "S2", 4: "S3", 5: "S5"}
    assert pairs(bands.only_active(picks, sites, "pick")) == {2: "S2", 4: "S3", 6: "S4"}
    day = picks.us - picks.us % DAY
    assert pairs(bands.by_priority(picks.where("us IS NOT NULL"), sites, "pick", day)) == {1: "S1", 2: "S2", 3: "S2", 4: "S3", 5: "S5", 6: "S4"}


def test_match_statuses(spark):
    table = spark.createDataFrame([(k, k / 2, k / 12, k / 12, k / 7, k / 7) for k in range(201)], "k int, distance double, tp_low double, tp_high double, ts_low double, ts_high double")
    events = spark.createDataFrame([(1, 0, 42.0, 0.0), (2, 600_000_000, 42.0, 0.0), (3, 601_000_000, 42.0, 0.0)], "event_uid bigint, origin bigint, lat double, lon double")
    stations = spark.createDataFrame([("A.X", "S1", 42.0, 0.1)], "code string, site_id string, latitude double, longitude double")
    rows = [(1, 1_400_000, "A.X", "P", 1), (2, 1_500_000, "A.X", "P", 2), (3, 50_000_000, "A.X", "P", 3), (4, 1_000_000, "N.O", "P", 4), (5, 601_500_000, "A.X", "P", 5), (6, 300_000_000, "A.X", "P", 6), (7, 2_000_000, "A.X", "S", 7)]
    picks = spark.createDataFrame(rows, "pick bigint, us bigint, code string, letter string, ord bigint")
    got = {r.pick: (r.status, r.event_uid) for r in picklists.matched_picks(picks, events, stations, table).collect()}
    assert got == {1: ("matched", 1), 2: ("duplicate", None), 3: ("no_residual", None), 4: ("no_station", None), 5: ("multi", None), 6: ("no_event", None), 7: ("matched", 1)}


def test_pick_lists(spark):
    picks = spark.createDataFrame([(1, 7, 1, "A.X", "P", 50), (2, 7, 2, "A.X", "Pg", 40), (3, 7, 3, "A.X", "S", None), (4, 8, 1, "A.X", "P", 10), (5, 8, 2, "B.X", "P", 5)], "pick_id bigint, event_uid bigint, pick_seq int, code string, phase string, us bigint")
    assert sorted(r.pick_id for r in picklists.first_picks(picks).collect()) == [1, 3, 4, 5]
    assert sorted((r.place, r.pick_id) for r in picklists.overridden(picks).collect()) == [(1, 2), (1, 4), (2, 5), (3, 3)]
    assert {r.pick_id: r.place for r in picklists.ordered_picks(picks).collect()} == {2: 1, 1: 2, 3: 3, 5: 1, 4: 2}
    groups = spark.createDataFrame([(7, 7), (8, 7)], "id bigint, group_id bigint")
    assert sorted(r.pick_id for r in picklists.merged_phases(groups, picks).collect()) == [1, 3, 5]


def test_inventory(spark):
    sites = _sites(spark, [("A.X", "S1", 42.0, 0.0, 0.0, 10, 20), ("A.X", "S2", 42.0, 0.0002, 7.0, 20, None), ("A.Y", "S3", 42.0, 0.0004, 3.0, 5, 9), ("B.X", "S4", 43.0, 0.0, 1.0, 1, 2)])
    merged = {r.code: (r.epochs, r.end_ts is None, r.elevation, r.oldest_site) for r in inventory.merged_stations(sites).collect()}
    assert merged == {"A.X": (2, True, 7.0, "S1"), "A.Y": (1, False, 3.0, "S3"), "B.X": (1, False, 1.0, "S4")}
    assert {r.code: r.alt_code for r in inventory.numbered_codes(sites).collect()} == {"A.X": "A.0000", "A.Y": "A.0001", "B.X": "B.0000"}
    assert {r.site_id: r.cluster for r in inventory.site_clusters(sites, 0.02, False).collect()} == {"S1": "S1", "S2": "S1", "S3": "S1"}
    assert {r.site_id: r.cluster for r in inventory.site_clusters(sites, 0.02, True).collect()} == {"S1": "S1", "S2": "S1"}


def test_existing_picks_make_duplicates(spark):
    from quakeloom.operators import picklists

    picks = spark.createDataFrame([(1, 10_000_000, "A.B", "P", 2), (2, 10_000_000, "A.B", "P", 1), (3, 10_000_000, "A.C", "P", 3)], "pick bigint, us bigint, code string, letter string, ord int")
    events = spark.createDataFrame([(7, 9_000_000, 42.0, 1.0)], "event_uid bigint, origin bigint, lat double, lon double")
    sites = spark.createDataFrame([("S1", "A.B", 42.0, 1.05), ("S2", "A.C", 42.0, 1.05)], "site_id string, code string, latitude double, longitude double")
    times = spark.createDataFrame([(k, k * 0.5, 0.0, 2.0, 0.0, 3.0) for k in range(30)], "k int, distance double, tp_low double, tp_high double, ts_low double, ts_high double")
    got = {r.pick: r.status for r in picklists.matched_picks(picks, events, sites, times).collect()}
    assert got == {1: "duplicate", 2: "matched", 3: "matched"}
    held = spark.createDataFrame([(7, "A.C", "P"), (7, "A.C", "P"), (None, "A.B", "P")], "event_uid bigint, code string, letter string")
    got = {r.pick: r.status for r in picklists.matched_picks(picks, events, sites, times, held).collect()}
    assert got == {1: "duplicate", 2: "matched", 3: "duplicate"}


def test_stations_removed_renamed_and_delays_joined(spark):
    from quakeloom.operators import inventory

    rows = [("S1", "N", "A", "N.A", 42.0, 1.0), ("S2", "N", "A", "N.A", 42.0002, 1.0), ("S3", "N", "A", "N.A", 43.0, 1.0), ("S4", "N", "B", "N.B", 43.0, 1.0)]
    sites = spark.createDataFrame(rows, "site_id string, network string, station string, code string, latitude double, longitude double")
    got = {r.site_id: r.code for r in inventory.renamed_sites(sites, 0.05).collect()}
    assert got == {"S1": "N.A", "S2": "N.A", "S3": "N.A_1", "S4": "N.B"}
    removal = spark.createDataFrame([("N", "A"), ("N", "A"), (None, "B")], "network string, station string")
    assert [r.site_id for r in inventory.without_stations(sites, removal).collect()] == ["S4"]
    delays = spark.createDataFrame([("N.A", "P", 0.5), ("N.Z", "P", 0.4)], "sta string, phase string, correction double")
    codes = spark.createDataFrame([("N.0000", "N.A"), ("N.0001", "N.A"), ("N.0000", "N.A")], "alt_code string, code string")
    got = sorted((r.sta, r.alt_code or "", r.missing) for r in inventory.delays_by_station(delays, codes).collect())
    assert got == [("N.A", "N.0000", False), ("N.A", "N.0001", False), ("N.Z", "", True)]

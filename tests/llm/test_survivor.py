import datetime as dt
import random

from quakeloom.llm import survivor

SCHEMA = "report_uid bigint, public_id string, source string, header_line string, picks array<string>, revised_ts timestamp"
SOURCES = [("A", 1), ("B", 2), ("C", 3)]


def _header(dep="1.0", mag="2.0", erh="0.1", erv="0.2", gap="100", rms="0.3"):
    return f"# 2020 1 2 3 4 5.2 42.9 -0.65 {dep} {mag} ML LDG 6.0 {erh} {erv} {gap} {rms}"


def _pick(code, phase="P"):
    return f"{code:9} ?    ?    ? {phase:6} ? 20200102 0304 07.100 GAU 0.05      "


def _run(spark, rows):
    s = spark.createDataFrame(SOURCES, "source string, trust_rank int")
    got = survivor.surviving_fields(spark.createDataFrame(rows, SCHEMA), s)
    return {(r.public_id, r.field_name): r.report_uid for r in got.collect()}


def _at(h):
    return dt.datetime(2020, 1, 1) + dt.timedelta(hours=h)


def test_rules(spark):
    rows = [
        (1, "X", "B", _header(dep="None", erh="-1.00"), [_pick("F.A"), _pick("F.A", "p"), _pick("F.B")], _at(5)),
        (2, "X", "A", _header(dep="Nan:7.5", mag="***", erh="-0.5", gap="?"), [_pick("F.A")], _at(1)),
        (3, "X", "A", _header(dep="-999.0", mag="-0.4", erh="Nan:Nan", gap="-999", rms="nan"), None, _at(3)),
        (4, "Y", "A", _header(), None, _at(1)),
        (5, None, "A", _header(), None, _at(1)),
        (6, "Z", "nobody", "# short", [], None),
        (7, "Z", None, None, None, None),
    ]
    assert _run(spark, rows) == {("X", "dep"): 2, ("X", "mag"): 3, ("X", "erv"): 3, ("X", "az_gap"): 1, ("X", "rms"): 2, ("X", "picks"): 1}


def test_against_brute_force(spark):
    rng = random.Random(3)
    value = lambda: rng.choice(["None", "-999", "nan", "?", "1.5", "Nan:2.0"])
    rows = []
    for i in range(400):
        picks = rng.choice([None, [], [_pick(f"F.{rng.randrange(4)}") for _ in range(rng.randrange(5))]])
        rows.append((i, f"G{int(rng.random() ** 3 * 20)}", rng.choice("ABC"), _header(*[value() for _ in range(6)]), picks, _at(i * 37 % 400)))
    trust = dict(SOURCES)
    want = {}
    for g in {r[1] for r in rows}:
        group = [r for r in rows if r[1] == g]
        if len(group) < 2:
            continue
        for f, (k, _) in survivor.FIELDS.items():
            ok = [r for r in group if r[3].split()[k + 1] in ("1.5", "Nan:2.0")]
            if ok:
                want[g, f] = min(ok, key=lambda r: (trust[r[2]], -r[5].timestamp()))[0]
        n = lambda r: len(set(r[4] or []))
        ok = [r for r in group if n(r)]
        if ok:
            want[g, "picks"] = min(ok, key=lambda r: (-n(r), trust[r[2]], -r[5].timestamp()))[0]
    assert _run(spark, rows) == want


def test_ties_repeats_and_empty(spark):
    rows = [(8, "X", "A", _header(), None, _at(1)), (8, "X", "A", _header(), None, _at(1))]
    assert _run(spark, rows) == {}
    rows += [(4, "X", "A", _header(), None, _at(1))]
    assert set(_run(spark, rows).values()) == {4}
    assert _run(spark, []) == {}


def test_layers_decide(spark):
    """The most complete, recent and trusted report lacks a field: it comes from the second or third layer."""
    rows = [
        (1, "X", "A", _header(erv="None"), [_pick("F.A")], _at(9)),
        (2, "X", "B", _header(erv="None", rms="nan", dep="None"), [_pick("F.A")], _at(5)),  # dominated by 1
        (3, "X", "B", _header(mag="None", rms="nan", dep="None", gap="?"), None, _at(3)),  # dominated by 1 and 2
    ]
    s = spark.createDataFrame(SOURCES, "source string, trust_rank int")
    got = {r.field_name: (r.report_uid, r.layer) for r in survivor.surviving_fields(spark.createDataFrame(rows, SCHEMA), s).collect()}
    assert got["erv"] == (3, 3) and got["dep"] == (1, 1) and got["picks"] == (1, 1)
    # an undominated but less trusted report has the field too: the layers alone prefer it, the exact walk does not
    rows += [(4, "X", "C", _header(), None, _at(10))]
    data = spark.createDataFrame(rows, SCHEMA)
    exact = {r.field_name: r.report_uid for r in survivor.surviving_fields(data, s).collect()}
    first = {r.field_name: (r.report_uid, r.layer) for r in survivor.surviving_fields(data, s, exact=False).collect()}
    assert exact["erv"] == 3 and first["erv"] == (4, 1)

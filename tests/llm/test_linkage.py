import math
import random

import numpy as np

from quakeloom.llm import linkage

SCHEMA = "id bigint, source string, us bigint, lat double, lon double"


def _links(spark, rows):
    return {(r.a, r.b): r.confidence for r in linkage.link(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_slips_and_conflicts(spark):
    s = 1_000_000
    rows = [
        (1, "A", 0, 42.5, 0.5), (2, "B", s // 2, 42.51, 0.51), (3, "C", s // 2, 42.5, 0.52),  # one earthquake, three sources
        (4, "A", 1000 * s, 42.5, 0.5), (5, "B", 1060 * s, 42.5, 0.5),  # a minute off
        (6, "A", 2000 * s, 42.5, 0.5), (7, "B", 2000 * s, 42.5, -0.5),  # sign of the longitude
        (8, "A", 3000 * s, 42.5, 0.5), (9, "B", 3000 * s, 0.5, 42.5),  # exchanged coordinates
        (10, "A", 4000 * s, 42.5, 0.5), (11, "B", 4000 * s, None, None), (12, "C", 4000 * s, 0.0, 0.0),  # no place
        (13, "A", 5000 * s, 42.5, 0.5), (14, "B", 5000 * s, 42.5, 0.5), (15, "B", 5003 * s, 42.55, 0.6),  # two candidates: the nearer
        (16, "A", 6000 * s, 42.5, 0.5), (17, "A", 6000 * s, 42.5, 0.5), (18, "B", 6000 * s, 42.5, 0.5),  # issued twice
        (19, "A", 7000 * s, 42.5, 0.5), (20, "B", 7005 * s, 43.3, 2.5),  # far apart
        (21, None, 0, 42.5, 0.5), (22, "B", None, 42.5, 0.5), (None, "C", 0, 42.5, 0.5), (1, "A", 0, 42.5, 0.5),
    ]
    got = _links(spark, rows)
    want = {(1, 2), (1, 3), (2, 3), (4, 5), (6, 7), (8, 9), (10, 11), (10, 12), (13, 14), (16, 18), (17, 18)}
    assert set(got) - {(11, 12)} == want  # two rows without place: by time alone, either way
    assert all(0.5 <= c <= 1 for c in got.values()) and got[1, 2] > 0.9


def test_recall_and_precision_on_noisy_copies(spark):
    rng = random.Random(1)
    rows, truth, k = [], set(), 0
    for _ in range(250):
        us, lat, lon, own = rng.randrange(0, 40_000_000_000), 42 + rng.random() * 1.5, -1 + rng.random() * 3, []
        for source in "ABC":
            if rng.random() < 0.7:
                rows.append((k, source, us + round(rng.gauss(0, 0.4e6)), lat + rng.gauss(0, 0.02), lon + rng.gauss(0, 0.03)))
                own.append(k)
                k += 1
        truth |= {(a, b) for a in own for b in own if a < b}
    got = set(_links(spark, rows))
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.03 * len(got)


def test_empty(spark):
    assert _links(spark, []) == {} and _links(spark, [(1, "A", 0, 42.5, 0.5)]) == {}


def _swarm(n, seed, span_s):
    """Rows of n earthquakes in few seconds and kilometres, read by most of four sources."""
    rng, rows = random.Random(seed), []
    for _ in range(n):
        us, lat, lon = rng.randrange(0, span_s * 1_000_000), 42.5 + rng.random() * 0.1, 0.5 + rng.random() * 0.1
        for source in "ABCD":
            if rng.random() < 0.8:
                rows.append((len(rows), source, us + round(rng.gauss(0, 0.5e6)), lat + rng.gauss(0, 0.02), lon + rng.gauss(0, 0.03)))
    return rows


def _all_rules_at_once(ground, rules, source):
    """The converged values with every rule in the problem from the start."""
    index = {(g.a, g.b): k for k, g in enumerate(ground)}
    target = np.array([g.target for g in ground])
    near = {}
    for a, b in index:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    at = lambda p, q: index.get((min(p, q), max(p, q)))
    terms, weight = [], []
    for hub, ends in near.items():
        for e1 in ends:
            for e2 in ends:
                if e1 < e2:
                    third = at(e1, e2)
                    apart = source[e1] == source[e2] and (third is None or target[third] < rules.accept)
                    weight.append(rules.exclusivity if apart else rules.transitivity)
                    third = None if apart else third
                    terms.append([(at(hub, e1), 1.0), (at(hub, e2), 1.0)] + ([(third, -1.0)] if third is not None else []))
    rule = np.array([r for r, ts in enumerate(terms) for _ in ts])
    pair, sign = (np.array([t[k] for ts in terms for t in ts]) for k in (0, 1))
    size, n = np.bincount(rule), np.bincount(pair, minlength=len(target))
    x, u = np.clip(target, 0, 1)[pair], np.zeros(len(pair))
    for _ in range(4000):
        z = np.clip((2 * target + np.bincount(pair, x + u, len(target))) / (2 + n), 0, 1)
        v = z[pair] - u
        x = v - np.clip((np.bincount(rule, sign * v) - 1) / size, 0, weight)[rule] * sign
        u += x - z[pair]
    return {k: z[i] for k, i in index.items()}


def test_values_are_those_of_the_converged_problem(spark):
    rows, rules = _swarm(30, 3, 60), linkage.Rules()
    source = {r[0]: r[1] for r in rows}
    events = spark.createDataFrame(rows, SCHEMA)
    want = _all_rules_at_once(linkage.grounded(linkage.candidate_pairs(events, rules), rules).collect(), rules, source)
    got = _links(spark, rows)
    assert all(abs(c - want[k]) < 0.01 for k, c in got.items())
    assert {k for k, v in want.items() if v > 0.51 and source[k[0]] != source[k[1]]} <= set(got)


def test_large_parts_settle_alike(spark, monkeypatch):
    rows = _swarm(3, 5, 4)
    events, rules = spark.createDataFrame(rows, SCHEMA), linkage.Rules(tolerance=1e-2)
    blocks = {(r.a, r.b): r.confidence for r in linkage.link(events, rules).collect()}
    monkeypatch.setattr(linkage, "BLOCK_ROWS", 0)
    monkeypatch.setattr(linkage, "_solve_block", None)
    spread = {(r.a, r.b): r.confidence for r in linkage.link(events, rules).collect()}
    assert blocks and all(abs(blocks.get(k, 0.5) - spread.get(k, 0.5)) < 0.1 for k in {*blocks, *spread})


def test_a_row_has_one_partner_in_a_source_or_twins(spark):
    s = 1_000_000
    rows = [(1, "A", 0, 42.5, 0.5), (2, "A", 1_400_000, 42.5, 0.5), (3, "B", 600_000, 42.5, 0.5), (4, "A", 100 * s, 42.5, 0.5), (5, "A", 102 * s, 42.5, 0.5), (6, "B", 101 * s, 42.5, 0.5)]
    assert set(_links(spark, rows)) == {(1, 3), (4, 6)}


def test_all_rows_within_the_rules_meet(spark):
    rng, rows = random.Random(9), []
    for lat, lon in ((42.5, 0.5), (-0.1, 179.9), (62.0, -179.9), (89.8, 10.0), (-84.0, 100.0)):
        for _ in range(40):
            rows.append((len(rows), rng.choice("AB"), rng.randrange(0, 10_000_000), max(-90.0, min(90.0, lat + rng.uniform(-0.5, 0.5))), (lon + rng.uniform(-1, 1) + 180) % 360 - 180))
    rows += [(len(rows), "C", 4_000_000, None, None)]

    def km(p, q):
        f = math.radians
        h = math.sin(f(q[3] - p[3]) / 2) ** 2 + math.cos(f(p[3])) * math.cos(f(q[3])) * math.sin(f(q[4] - p[4]) / 2) ** 2
        return 2 * 6371 * math.asin(min(1, math.sqrt(h)))

    found = linkage.candidate_pairs(spark.createDataFrame(rows, SCHEMA), linkage.Rules()).collect()
    plain, blind = {(r.a, r.b) for r in found if r.slip == 0}, {(r.a, r.b) for r in found if r.b == 200}
    near = {(p[0], q[0]) for p in rows[:-1] for q in rows[:-1] if p[0] < q[0] and km(p, q) <= 47.5 and abs(p[2] - q[2]) <= 8_000_000}
    assert near <= plain and len(near) > 500
    assert {(p[0], 200) for p in rows[:-1] if abs(p[2] - 4_000_000) <= 2_700_000} <= blind

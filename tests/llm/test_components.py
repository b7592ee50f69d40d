import random

from quakeloom.llm import components


def _brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {x: find(x) for x in parent}


def _run(spark, edges, cell_edges=components.CELL_EDGES):
    got = components.connected_groups(spark.createDataFrame(edges, "u bigint, v bigint"), cell_edges)
    rows = got.collect()
    assert len({r.v for r in rows}) == len(rows)
    return {r.v: r.group for r in rows}


def test_random_graphs_over_many_cells(spark):
    rng = random.Random(1)
    for n, cell in ((80, 12), (110, 1000)):
        edges = [(rng.randrange(100), rng.randrange(100)) for _ in range(n)]
        assert _run(spark, edges, cell) == _brute(edges)


def test_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(200)]
    random.Random(2).shuffle(chain)
    assert _run(spark, chain, 100) == {i: 0 for i in range(201)}
    star = [(1_000 + i, 999) for i in range(2_000)]
    assert set(_run(spark, star, 600).values()) == {999}


def test_several_cells_at_every_size(spark, monkeypatch):
    seen = []
    exchanged = components._exchanged
    monkeypatch.setattr(components, "_exchanged", lambda e, blocks, *a: seen.append(blocks) or exchanged(e, blocks, *a))
    edges = [(i, i + 1) for i in range(0, 40, 2)] + [(i, i + 3) for i in range(0, 40, 5)]
    assert _run(spark, edges) == _brute(edges)
    assert len(seen) > 1 and min(seen) >= 4


def test_hot_cell_is_split(spark):
    """A hub beside single edges: the cells of its row are split, and nothing is lost."""
    edges = [(0, i) for i in range(1, 601)] + [(10_000 + 2 * i, 10_001 + 2 * i) for i in range(20)]
    assert _run(spark, edges, 20) == _brute(edges)


def test_nulls_loops_repeats_empty(spark):
    assert _run(spark, [(1, None), (None, 2), (3, 3), (4, 5), (5, 4), (4, 5), (-7, 5)]) == {3: 3, 4: -7, 5: -7, -7: -7}
    assert _run(spark, []) == {}


def test_reports(spark):
    header = "# 2020 1 2 3 4 5.25 42.9 -0.65 8.0 1.7 ML LDG 6.0 None None 120.0 0.21"
    reports = [(1, "P_0007", header), (2, "P_0007", "x"), (3, "P_0008", "y"), (4, None, header), (5, None, "z"), (6, "P_0009", None), (6, "P_0009", None), (None, "P_0009", None)]
    links = [("p_7", " P_08", "k"), ("#  2020 01 2 3 4 05.25 42.9 -0.65 8.0 1.7 ml ldg 6.0 none NONE 120.0 0.21", "P_0010", "k"), ("P_9", "P_8", "s"), ("P_9", "P_9", "k"), (None, "P_9", "k")]
    r = spark.createDataFrame(reports, "report_uid bigint, public_id string, header_line string")
    k = spark.createDataFrame(links, "ref_a string, ref_b string, decision string")
    got = {x.report_uid: x.group_uid for x in components.report_groups(r, k).collect()}
    assert got == {1: 1, 2: 1, 3: 1}
    k = k.union(spark.createDataFrame([(header, "P_8", "k")], "ref_a string, ref_b string, decision string"))
    got = {x.report_uid: x.group_uid for x in components.report_groups(r, k).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1}

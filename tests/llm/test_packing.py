import itertools
import random
from collections import defaultdict

import numpy as np

from quakeloom.llm import packing

SIZES = "doc_id bigint, tokens int"
PACKS = "pack_name string, capacity_tokens int"


def _run(spark, sizes, packs):
    return packing.pack(spark.createDataFrame(sizes, SIZES), spark.createDataFrame(packs, PACKS)).collect()


def test_whole_documents_within_capacity(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 150)
    rng = random.Random(1)
    sizes = [(i, rng.choice([0, 1, 5, 100, 120, 240, 512, 513, 1030, rng.randrange(1, 400)])) for i in range(700)]
    rows = _run(spark, sizes + sizes[:9], [("s", 512), ("m", 2048)])
    for name, capacity in (("s", 512), ("m", 2048)):
        own = [r for r in rows if r.pack_name == name]
        fill, of = defaultdict(int), defaultdict(list)
        for r in own:
            fill[r.bin_id] += r.tokens
            of[r.doc_id].append((r.piece, r.tokens))
        assert max(fill.values()) <= capacity
        assert {d: sum(t for _, t in p) for d, p in of.items()} == dict(sizes)
        for d, p in of.items():
            assert sorted(k for k, _ in p) == list(range(len(p))) and (len(p) == 1 or dict(sizes)[d] > capacity)
        assert len(fill) <= 1.03 * -(-sum(fill.values()) // capacity) + 1


def test_nulls_and_empty(spark):
    assert _run(spark, [], [("s", 10)]) == [] and _run(spark, [(1, 3)], []) == []
    rows = _run(spark, [(1, 3), (None, 4), (2, None), (3, 0)], [("s", 10), (None, 5), ("z", 0), ("y", None)])
    assert sorted((r.doc_id, r.tokens) for r in rows) == [(1, 3), (3, 0)]


def _fewest(sizes, capacity):
    for n in range(1, len(sizes) + 1):
        for where in itertools.product(range(n), repeat=len(sizes)):
            fill = np.bincount(where, weights=sizes, minlength=n)
            if fill.max() <= capacity:
                return n
    return 0


def test_local_search_improves_and_is_near_the_best():
    rng = random.Random(2)
    extra = 0
    for _ in range(12):
        sizes = np.array([rng.randrange(2, 9) for _ in range(7)])
        squares = lambda w: np.sum(np.bincount(w, weights=sizes) ** 2)  # noqa: B023, E731
        for start in (np.arange(len(sizes)), packing.first_fit(sizes, 10)):  # alone, or first fit
            where = packing.local_search(sizes, start, 10)
            fill = np.bincount(where, weights=sizes)
            assert fill.max() <= 10
            assert squares(where) >= squares(start)
        extra += len(set(where.tolist())) - _fewest(sizes, 10)
    assert extra <= 1


def test_no_step_is_left():
    """Against brute force: after the search no move, exchange or two-for-one exchange fits."""
    rng = random.Random(4)
    for _ in range(30):
        sizes = np.array([rng.randrange(1, 30) for _ in range(25)])
        where = packing.local_search(sizes, packing.first_fit(sizes, 40), 40)
        fill = np.bincount(where, weights=sizes).astype(int)
        for x in range(len(sizes)):
            for b in range(len(fill)):
                a = where[x]
                if a == b or not fill[a] <= fill[b] < 40:
                    continue
                own = [i for i in range(len(sizes)) if where[i] == b]
                for out in [(), *itertools.combinations(own, 1), *itertools.combinations(own, 2)]:
                    gain = sizes[x] - sum(sizes[i] for i in out)
                    assert not (0 < gain <= 40 - fill[b]) or fill[a] == fill[b], (sizes, where, x, b, out)


def test_search_empties_containers(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ITEMS", 100)
    rng = random.Random(3)
    sizes = spark.createDataFrame([(i, rng.randrange(10, 200)) for i in range(500)], SIZES)
    packs = spark.createDataFrame([("s", 256)], PACKS)
    bins = {search: packing.pack(sizes, packs, search).select("bin_id").distinct().count() for search in (True, False)}
    rounds = packing.packed_rounds(sizes, packs)[1].collect()
    total = sizes.groupBy().sum("tokens").first()[0]
    assert bins[True] <= 1.03 * total / 256 + 1 < bins[False]
    assert sum(r.emptied for r in rounds) > 0 and len(rounds) > 1


def test_two_for_one_exchange():
    # room 1 in the second container: only 7 for 4 and 2 fills it
    sizes = np.array([7, 1, 4, 2, 3])
    where = packing.local_search(sizes, np.array([0, 0, 1, 1, 1]), 10)
    assert sorted(np.bincount(where, weights=sizes).tolist()) == [7, 10]


def test_many_short_documents():
    """A container of hundreds of documents: all of them take part in exchanges."""
    sizes = np.array([1] * 500 + [2] * 200 + [3] * 100 + [90, 95, 97])
    where = packing.local_search(sizes, packing.first_fit(sizes[::-1].copy(), 1000)[::-1].copy(), 1000)
    assert np.bincount(where, weights=sizes).max() <= 1000
    assert len(set(where.tolist())) == 2

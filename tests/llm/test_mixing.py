import numpy as np
import pytest

from quakeloom.llm import mixing

SIZES = "doc_id bigint, source string, tokens int"
TARGETS = "source string, target_share double, max_repeats int"


def _mix(spark, sizes, targets):
    s, t = spark.createDataFrame(sizes, SIZES), spark.createDataFrame(targets, TARGETS)
    mixed = mixing.mix(s, t).cache()
    return mixed.collect(), {r.source: r for r in mixing.shares(mixed, t).collect()}


def test_shares_and_caps(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ITEMS", 60)
    rng = np.random.default_rng(1)
    sizes = [(i, "abc"[min(2, i // 500)], int(rng.integers(1, 80))) for i in range(1100)]
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.2, 4), ("none", 0.0, 3)]
    rows, shares = _mix(spark, sizes + sizes[:7] + [(5000, "other", 9), (5001, None, 9), (None, "a", 9)], targets)
    cap = {s: m for s, _, m in targets}
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.copies <= cap[r.source] for r in rows)
    total = sum(r.tokens * r.copies for r in rows)
    for source, share, _ in targets[:3]:
        assert abs(shares[source].mix_tokens - share * total) <= 3 * 80
        assert shares[source].actual_share == pytest.approx(share, abs=0.01)
    assert shares["none"].documents == 0


def test_rounding_keeps_tokens_and_expectations():
    weight = np.random.default_rng(2).integers(1, 50, 40).astype(float)
    hits = np.zeros(40)
    for seed in range(600):
        p = mixing.pivotal(np.full(40, 0.3), weight, np.random.default_rng(seed))
        assert np.sum((p > 0) & (p < 1)) <= 1
        assert np.sum(p * weight) == pytest.approx(0.3 * weight.sum())
        hits += p
    assert np.abs(hits / 600 - 0.3).max() < 0.1


def test_same_result_again(spark):
    sizes = [(i, "ab"[i % 2], i % 13 + 1) for i in range(200)]
    targets = [("a", 0.9, 1), ("b", 0.1, 1)]
    assert sorted(_mix(spark, sizes, targets)[0]) == sorted(_mix(spark, sizes, targets)[0])


def test_edges(spark):
    assert _mix(spark, [], [("a", 1.0, 2)])[0] == []
    assert _mix(spark, [(1, "a", 5)], [])[0] == []
    rows, shares = _mix(spark, [(1, "a", 5), (2, "a", 0), (3, "b", 0)], [("a", 0.5, 3), ("b", 0.5, 3)])
    assert {r.doc_id: r.copies for r in rows} == {1: 3, 2: 3} and shares["b"].mix_tokens == 0


def test_seeds_give_other_mixes_of_the_same_shares(spark):
    sizes = spark.createDataFrame([(i, "ab"[i % 2], i % 13 + 1) for i in range(300)], SIZES)
    targets = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 1)], TARGETS)
    mixes = [mixing.mix(sizes, targets, seed).cache() for seed in (0, 1, 2)]
    ids = [frozenset(r.doc_id for r in m.collect()) for m in mixes]
    assert len(set(ids)) == 3
    for m in mixes:
        assert {r.source: r.actual_share for r in mixing.shares(m, targets).collect()} == pytest.approx({"a": 0.9, "b": 0.1}, abs=0.02)

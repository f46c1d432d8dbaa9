"""Replicates by ranges against draws one by one."""

import hashlib
import math
import random

import numpy as np
import pytest

from veriscreen.functions.shuffle import mixed
from veriscreen.operators import audit, resampling


def one(key):
    """mixed() of one number, in Python's integers."""
    for _ in range(2):
        key = ((key ^ key >> 16) * 0x45D9F3B) & ((1 << 31) - 1)
    return key ^ key >> 16


def quantile(t, p, u):
    total = 0.0
    for k in range(t + 1):
        total += math.comb(t, k) * p**k * (1 - p) ** (t - k)
        if total >= u:
            return k
    return t


def drawn(n, leaf, key, first, last, total):
    """Places that a range's draws take, the range cut in halves down to leaves."""
    if last - first == 1:
        return [first * leaf + one(key ^ d) % (min(n, last * leaf) - first * leaf) for d in range(total)]
    middle = (first + last) // 2
    u = (one(key ^ 3) * 2.0**31 + one(key ^ 4)) / 2.0**62
    left = quantile(total, (middle - first) * leaf / (min(last * leaf, n) - first * leaf), u)
    return drawn(n, leaf, one(key ^ 1), first, middle, left) + drawn(n, leaf, one(key ^ 2), middle, last, total - left)


def brute(rows, replicates, leaf, seed=42):
    out = {}
    for g in {r[0] for r in rows}:
        own = [x for _, _, x in sorted((hashlib.md5(str(i).encode()).hexdigest(), i, x) for h, i, x in rows if h == g)]
        key = int(hashlib.md5(f"{seed}:{g}".encode()).hexdigest()[:7], 16)
        for r in range(replicates):
            x = [own[i] for i in drawn(len(own), leaf, one(key ^ r), 0, -(-len(own) // leaf), len(own))]
            assert len(x) == len(own)
            out[g, r] = np.mean(x), (np.var(x, ddof=1) if len(x) > 1 else None)
    return out


@pytest.mark.parametrize("leaf", [7, 64, resampling.LEAF])
def test_replicates_equal_draws_one_by_one(spark, leaf):
    rng = random.Random(1)
    rows = [(g, k, rng.random() + 1e6 * (g == "far")) for g, n in (("a", 150), ("b", 41), ("far", 8), ("one", 1)) for k in range(n)]
    df = spark.createDataFrame(rows, "g string, pmid long, x double").repartition(5)
    got = {(r.g, r.replicate): (r["mean"], r.variance) for r in audit.resampled(df, "g", "x", 100, leaf=leaf).collect()}
    want = brute(rows, 100, leaf)
    assert got.keys() == want.keys()
    for k, (mean, spread) in want.items():
        assert got[k][0] == pytest.approx(mean, rel=1e-12) and (got[k][1] == pytest.approx(spread, rel=1e-6, abs=1e-9) if spread is not None else got[k][1] is None)


def test_binomials_follow_their_distribution_function():
    rng = np.random.default_rng(1)
    for p in (0.5, 0.03, 0.97, 1 / 3):
        total, u = rng.integers(0, 300, 500), rng.random(500)
        assert resampling.binomial(total, p, u).tolist() == [quantile(t, p, x) for t, x in zip(total.tolist(), u.tolist())]
    large = resampling.binomial(np.full(2000, 10_000_000), 0.25, rng.random(2000))
    assert abs(large.mean() - 2.5e6) < 4 * math.sqrt(1.875e6 / 2000) and 0.85 < large.var() / 1.875e6 < 1.15


def test_leaves_share_all_draws_of_a_replicate():
    n, leaf = 1_003, 50
    key = mixed(np.arange(400, dtype=np.int64) ^ 77)
    counts = np.array([resampling.leaf_counts(n, leaf, k, key)[0] for k in range(-(-n // leaf))])
    assert (counts.sum(axis=0) == n).all()
    assert abs(counts[:-1].mean() - 50 * n / n) < 0.5 and 0.8 < counts[:-1].var() / (50 * (1 - 50 / n)) < 1.2  # as a multinomial's
    assert abs(np.corrcoef(counts[3], counts[4])[0, 1]) < 0.2


def test_no_draw_becomes_a_row(spark):
    df = spark.createDataFrame([("a", k, k / 10) for k in range(100)], "g string, pmid long, x double")
    plan = audit.resampled(df, "g", "x", 100, leaf=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan


def test_intervals_agree_with_draws_of_another_kind(spark):
    rng = np.random.default_rng(5)
    x = rng.beta(2, 5, 800)
    df = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(x)], "g string, pmid long, x double")
    got = audit.bootstrap(df, "g", "x", 4000, leaf=30).first()
    means = x[rng.integers(0, 800, (4000, 800))].mean(axis=1)
    assert (got.mean_low, got.mean_high) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])), abs=0.001)


def test_groups_without_rows(spark):
    assert audit.resampled(spark.createDataFrame([], "g string, pmid long, x double"), "g", "x", 100).collect() == []
    with pytest.raises(ValueError, match="100 replicates"):
        audit.resampled(spark.createDataFrame([("a", 1, 1.0)], "g string, pmid long, x double"), "g", "x", 99)


@pytest.mark.parametrize("n, leaf", [(1_003, 50), (997, 16), (16, 16), (5, 16)])
def test_a_block_of_leaves_has_the_counts_of_its_leaves(monkeypatch, n, leaf):
    key, leaves = mixed(np.arange(200, dtype=np.int64) ^ 5), -(-n // leaf)
    for start, stop in ((0, leaves), (leaves // 2, leaves), (leaves // 3, leaves // 3 + 1)):
        counts, keys = resampling.block_counts(n, leaf, start, stop, key)
        for k in range(start, stop):
            want = resampling.leaf_counts(n, leaf, k, key)
            assert (counts[k - start] == want[0]).all() and (keys[k - start] == want[1]).all()
    x = np.random.default_rng(2).random(n)
    monkeypatch.setattr(resampling, "SPLITS", 300)
    pieces = []
    for draws in (1, 700, 1 << 20):  # sums do not depend on the pieces in which draws are made
        monkeypatch.setattr(resampling, "DRAWS", draws)
        pieces.append(resampling._folded(x, n, leaf, 0, 42, 200))
    for one, two in pieces[1:]:
        assert one == pytest.approx(pieces[0][0], rel=1e-12) and two == pytest.approx(pieces[0][1], rel=1e-12)


def test_ranges_are_split_once_for_a_block_and_blocks_are_tasks(spark, monkeypatch):
    calls = []
    split = resampling.binomial
    monkeypatch.setattr(resampling, "binomial", lambda *a: calls.append(len(a[0])) or split(*a))
    resampling._folded(np.arange(1024.0), 1024, 16, 0, 1, 100)
    assert sum(calls) == 63 * 100  # a split for each inner range and replicate; 6 for each of 64 leaves before
    df = spark.createDataFrame([(g, k, k / 10) for g in "abcdef" for k in range(500)], "g string, pmid long, x double")
    assert audit.resampled(df, "g", "x", 100).rdd.getNumPartitions() >= 1
    monkeypatch.setattr(resampling, "BLOCK", 100)
    plan = audit.resampled(df, "g", "x", 100, leaf=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan and ", 60" in plan.split("RepartitionByExpression")[1].split("\n")[0]

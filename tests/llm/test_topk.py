"""Exact top-k search against plain Python integers."""

import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from veriscreen.llm import topk


def brute(rows, k, asks, scale=1024):
    own = [(i, [math.floor(float(x) * scale) if abs(x) < 1e300 else int(np.nan_to_num(np.float64(x) * scale)) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(own):
        if i is None or not asks(i):
            continue
        found = sorted((-max(-topk.LONG, min(topk.LONG, sum(x * y for x, y in zip(q, v)))), j is None, j or 0) for b, (j, v) in enumerate(own) if b != a and len(v) == len(q))
        out += [(i, r + 1, None if unknown else j, -s) for r, (s, unknown, j) in enumerate(found[:k])]
    return sorted(out, key=repr)


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, n int, `items.n` string").repartition(5)


def made(seed, n, dim, spread=1.0):
    rng = np.random.default_rng(seed)
    return [(k, (np.round(rng.normal(size=dim), 1) * spread).astype(np.float32).tolist()) for k in range(n)]


@pytest.mark.parametrize("side_bytes, least_shard", [(topk.SIDE_BYTES, topk.LEAST_SHARD), (8 * 3 * 7, 9)])
def test_tables_with_ties_copies_and_odd_rows(spark, side_bytes, least_shard):
    rows = made(1, 300, 3) + [(10, [0.0] * 3)] * 40 + [(10, [0.5] * 3), (20, [0.5] * 3), (None, [9.0] * 3), (None, [0.0] * 3)]
    rows += [(30, None), (40, [1.0, None, 2.0]), (50, [math.nan] * 3), (60, [math.inf] * 3), (70, []), (71, []), (80, [1.0]), (90, [1.0] * 5), (91, [-1.0] * 5)]
    random.Random(1).shuffle(rows)
    got = topk.search(vectors(spark, rows), F.col("vec_id") % 10 == 0, side_bytes=side_bytes, least_shard=least_shard)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 10, lambda i: i % 10 == 0)


@pytest.mark.parametrize("spread", [1.0, 1e3, 1e6, 1e16, 1e160, 1e308])
def test_products_are_exact_in_every_precision(spark, spread):
    rng = np.random.default_rng(3)
    rows = [(k, (rng.normal(size=4) * (spread if k % 3 else 1.0)).tolist()) for k in range(60)]
    rows = [(k, [x if math.isfinite(x) else 1e308 for x in v]) for k, v in rows]
    got = topk.search(vectors(spark, rows, "double"), k=3, least_shard=16)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 3, lambda i: True)


def test_one_vector_that_fills_a_third_of_the_table(spark):
    rows = made(2, 200, 8) + [(500, [1.0] * 8)] * 100
    got = topk.search(vectors(spark, rows), F.col("vec_id") == 500, least_shard=32)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 10, lambda i: i == 500)


def test_lists_merge_in_a_tree(spark):
    """More shards than FAN: two levels of merging."""
    rows = made(4, 600, 4)
    got = topk.search(vectors(spark, rows), F.col("vec_id") % 100 == 0, side_bytes=1, least_shard=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, 10, lambda i: i % 100 == 0)


def test_empty_table(spark):
    assert topk.search(vectors(spark, [])).collect() == []
    assert topk.search(vectors(spark, [(1, [1.0])]), F.col("vec_id") == 1).collect() == []

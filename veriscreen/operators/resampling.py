"""Bootstrap replicates without a row for each draw: counts are split down a tree of ranges, draws happen where the values lie.

A replicate of a group of n values is n draws with replacement. The group's values, numbered from 0, are cut into leaves of `leaf` values. How many of the
draws fall into the left part of a range is binomial, so the tree of ranges is descended from the n draws of the whole group: at each range a
number seeded by group, replicate and range is turned into a binomial count by its exact distribution function. A task that holds a block of leaves
(about BLOCK values, one leaf at least) so finds its own counts for each replicate alone, and splits each range above or in its block once; it draws that many of
its values, and folds them into their sum and sum of squares. What leaves it is a row a replicate and block; replicates are sums over blocks. Nothing is
joined, and no draw becomes a row.

The work that stays is a few machine operations a draw, in NumPy, on pieces that a core's cache holds. Seeds are mixed from integers, so any engine can repeat
the draws. A group of up to `leaf` values is one leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from ..functions.shuffle import mixed
from ..sources.scratch import materialized

LEAF = 50_000
BLOCK = 1 << 14  # values of the leaves that a task takes together, about
SPLITS = 1 << 20  # counts of leaves and replicates that are held at once
DRAWS = 1 << 16  # draws that are held at once, or those of a replicate in a block
LEFT, RIGHT, HIGH, LOW = 1, 2, 3, 4  # what a range's seed is mixed with: for its halves, and for its own number


def uniform(key: np.ndarray) -> np.ndarray:
    """A number between 0 and 1 of 62 bits for each seed."""
    return (mixed(key ^ HIGH).astype(np.float64) * 2.0**31 + mixed(key ^ LOW)) / 2.0**62


def binomial(total: np.ndarray, p: float, u: np.ndarray) -> np.ndarray:
    """For each total the least k whose binomial distribution function reaches u."""
    out = np.zeros(len(total), np.int64)
    order = np.argsort(total.astype(np.uint16) if total.max(initial=0) < 1 << 16 else total, kind="stable")  # short numbers are sorted by digits
    values, starts = np.unique(total[order], return_index=True)
    odds = np.log(p) - np.log1p(-p)
    for t, own in zip(values.tolist(), np.split(order, starts[1:])):
        wide = int(10 * np.sqrt(t * p * (1 - p))) + 30  # the chance of more is below 1e-20
        mode = int((t + 1) * p)
        low, high = max(0, mode - wide), min(t, mode + wide)
        k = np.arange(low + 1, high + 1)
        weight = np.concatenate(([0.0], np.cumsum(np.log((t - k + 1) / k) + odds)))
        sums = np.cumsum(np.exp(weight - weight.max()))
        out[own] = low + np.searchsorted(sums / sums[-1], u[own], "left").clip(0, high - low)
    return out


def leaf_counts(n: int, leaf: int, index: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Draws of each replicate that fall into a leaf, and the seed of each there."""
    total, first, last = np.full(len(key), n, np.int64), 0, -(-n // leaf)
    while last - first > 1:
        middle = (first + last) // 2
        left = binomial(total, (middle - first) * leaf / (min(last * leaf, n) - first * leaf), uniform(key))
        if index < middle:
            total, key, last = left, mixed(key ^ LEFT), middle
        else:
            total, key, first = total - left, mixed(key ^ RIGHT), middle
    return total, key


def block_counts(n: int, leaf: int, start: int, stop: int, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """leaf_counts of the leaves start .. stop - 1, a row each: the tree is descended level by level, all ranges that meet these leaves at once."""
    first, last = np.array([0]), np.array([-(-n // leaf)])
    total, key = np.full((1, len(key)), n, np.int64), key[None, :]
    while (wide := last - first > 1).any():
        middle = (first + last) // 2
        share = (middle - first) * leaf / (np.minimum(last * leaf, n) - first * leaf)
        left = np.zeros_like(total)
        for p in np.unique(share[wide]).tolist():
            own = np.flatnonzero(wide & (share == p))
            left[own] = binomial(total[own].ravel(), p, uniform(key[own]).ravel()).reshape(len(own), -1)
        parent = np.repeat(np.arange(len(first)), 1 + wide)
        side = np.where(wide[parent], np.where(np.append(False, parent[1:] == parent[:-1]), RIGHT, LEFT), 0)
        low, high = np.where(side == RIGHT, middle[parent], first[parent]), np.where(side == LEFT, middle[parent], last[parent])
        kept = (high > start) & (low < stop)
        parent, side, first, last = parent[kept], side[kept], low[kept], high[kept]
        total, left, key = total[parent], left[parent], key[parent]
        at = side > 0
        total[at] = np.where((side[at] == LEFT)[:, None], left[at], total[at] - left[at])
        key[at] = mixed(key[at] ^ side[at][:, None])
    return total, key


def _folded(x: np.ndarray, n: int, leaf: int, start: int, seed: int, replicates: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and sum of squares of what each replicate draws of the leaves from `start` on that x is of."""
    one, two = np.zeros(replicates), np.zeros(replicates)
    leaves = -(-len(x) // leaf)
    begin = np.arange(leaves, dtype=np.uint32) * np.uint32(min(leaf, len(x)))
    size = np.minimum(begin.astype(np.int64) + leaf, len(x)).astype(np.uint32) - begin
    wide, some = max(1, SPLITS // leaves), max(1, DRAWS // len(x))
    keys = mixed(seed ^ np.arange(replicates, dtype=np.int64))
    for a in range(0, replicates, wide):
        counts, own = block_counts(n, leaf, start, start + leaves, keys[a : a + wide])
        counts, own = counts.T, own.T.astype(np.uint32)
        for b in range(0, len(counts), some):
            count = counts[b : b + some].ravel()
            ends = np.cumsum(count)
            if not ends[-1]:
                continue
            if len(count) == 1:
                taken = mixed(own[b, 0] ^ np.arange(ends[-1], dtype=np.uint32))
            else:
                taken = mixed(np.repeat(own[b : b + some].ravel(), count) ^ (np.arange(ends[-1], dtype=np.uint32) - np.repeat((ends - count).astype(np.uint32), count)))
            if size[0] == size[-1]:
                taken -= taken // size[0] * size[0]
            else:
                taken %= np.repeat(np.tile(size, len(count) // leaves), count)
            if leaves > 1:
                taken += np.repeat(np.tile(begin, len(count) // leaves), count)
            drawn = x[taken]
            each = count.reshape(-1, leaves).sum(axis=1)
            full = np.flatnonzero(each)
            at = (np.cumsum(each) - each)[full]
            one[a + b + full] = np.add.reduceat(drawn, at)
            two[a + b + full] = np.add.reduceat(drawn * drawn, at)
    return one, two


def resampled(values: DataFrame, by: str, value: str, replicates: int, seed: int = 42, order: str = "pmid", leaf: int = LEAF) -> DataFrame:
    """(group, replicate, mean, variance) of samples with replacement, as large as the group. Rows with a null group are left out."""
    if replicates < 100:
        raise ValueError("at least 100 replicates are needed")
    values = materialized(values.select(F.col(by).alias("g"), F.col(value).cast("double").alias("x"), F.col(order).alias("_id")), "values")
    values = materialized(numbered(values, F.md5(F.col("_id").cast("string").cast("binary")), "i", ["g"]).select("g", "i", "x"), "numbered")
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("g").cast("string")).cast("binary")), 1, 7), 16, 10).cast("long")
    sizes = values.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("middle")).withColumn("key", key)
    width = max(1, BLOCK // leaf) * leaf  # values of a block
    blocks = sizes.agg(F.sum(F.ceil(F.col("n") / width))).first()[0] or 1
    rows = values.join(sizes, "g").select("g", "n", "key", "i", (F.col("x") - F.col("middle")).alias("x"))
    # a number of partitions is given, as few bytes are much work: adaptive execution would put all blocks into one task
    rows = rows.repartition(min(2 * blocks, 4096), F.xxhash64("g", F.floor(F.col("i") / width))).sortWithinPartitions("g", "i")
    kind = rows.schema["g"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, n, own, index, held = None, 0, 0, 0, []

        def folded() -> pa.RecordBatch:
            one, two = _folded(np.concatenate(held), n, leaf, index, own, replicates)
            return pa.RecordBatch.from_arrays([pa.repeat(g, replicates), pa.array(np.arange(replicates, dtype=np.int32)), pa.array(one), pa.array(two)], ["g", "replicate", "one", "two"])

        for batch in batches:
            i, x = batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False)
            edges = [0, *np.flatnonzero(i % width == 0).tolist(), len(i)]  # a block begins
            for a, b in zip(edges[:-1], edges[1:]):
                if a < b:
                    if i[a] % width == 0:
                        if held:
                            yield folded()
                        g, n, own, index, held = batch.column(0)[a], batch.column(1)[a].as_py(), batch.column(2)[a].as_py(), int(i[a]) // leaf, []
                    held.append(x[a:b])
        if held:
            yield folded()

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("g", kind), T.StructField("replicate", T.IntegerType()), T.StructField("one", T.DoubleType()), T.StructField("two", T.DoubleType())])
    sums = rows.mapInArrow(run, schema).groupBy("g", "replicate").agg(F.sum("one").alias("one"), F.sum("two").alias("two")).join(sizes.select("g", "n", "middle"), "g")
    spread = (F.col("two") - F.col("one") * F.col("one") / F.col("n")) / (F.col("n") - 1)
    return sums.select(F.col("g").alias(by), "replicate", (F.col("middle") + F.col("one") / F.col("n")).alias("mean"), F.when(F.col("n") > 1, F.greatest(F.lit(0.0), spread)).alias("variance"))

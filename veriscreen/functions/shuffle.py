"""A seeded order of numbered rows without sorting them: each row computes its own place."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 4
MASK, FACTOR = (1 << 31) - 1, 0x45D9F3B  # of the mixing of 31-bit numbers: products stay below 2**62 in any engine


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 31-bit numbers that leaves no visible structure."""
    for _ in range(2):
        x = ((x ^ (x >> 16)) * FACTOR) & MASK
    return x ^ (x >> 16)


def keys(seed: int, epoch: int) -> list[int]:
    """A key for each half round."""
    return [int(hashlib.md5(f"{seed}:{epoch}:{k}".encode()).hexdigest()[:7], 16) for k in range(2 * ROUNDS)]


def sides(n: int) -> tuple[int, int]:
    """Two lengths whose product is n or little more."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def places(rows: np.ndarray, n: int, own: list[int]) -> np.ndarray:
    """The places of rows 0 .. n - 1 in a keyed order of them: Feistel rounds over a grid of sides(n), whose two coordinates take turns in shifting each
    other; what lands on the grid's few cells beyond n goes on until it lands below, which keeps the order a bijection."""
    a, b = sides(n)
    out, open_ = rows.astype(np.int64), np.arange(len(rows))
    while len(open_):
        left, right = np.divmod(out[open_], b)
        for k in range(0, len(own), 2):
            left = (left + mixed(right ^ own[k])) % a
            right = (right + mixed(left ^ own[k + 1])) % b
        out[open_] = left * b + right
        open_ = open_[out[open_] >= n]
    return out


def shuffled(row: Column, n: int, seed: int, epoch: int) -> Column:
    """The place of row number `row` (0 to n - 1) in the order of an epoch."""
    if not 0 <= n <= 1 << 60:
        raise ValueError("between 0 and 2**60 rows can be shuffled")
    own = keys(seed, epoch)

    def run(values: pa.Array) -> pa.Array:
        return pa.array(places(values.to_numpy(zero_copy_only=False), n, own))

    return F.arrow_udf(run, "long")(row)

"""Deterministic order by hashes, and numbering without sorting everything in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sample_rank(seed: int | str, key: Column) -> Column:
    """Hexadecimal SHA-256 of seed, a zero character and the key: orders as its bytes do."""
    return F.sha2(F.concat(F.lit(f"{seed}\0"), key), 256)


PART = 50_000  # rows that are numbered or summed within one part, about


def parts_for(rows: int) -> int:
    return max(1, -(-rows // PART))


def numbered(df: DataFrame, order: Column, out: str, by: list[str] | None = None) -> DataFrame:
    """df with its row number (from 0) in the order of a hexadecimal hash, for each value of the columns `by`.

    Rows are numbered within the hash's first digits, as many as make parts of about PART rows; only the counts of those
    parts meet in a window.
    """
    by, digits, rows = by or [], 1, df.count()
    while 16**digits * PART < rows:
        digits += 1
    df = df.withColumn("_order", order).withColumn("_part", F.substring("_order", 1, digits))
    parts = df.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(before.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_order")) - 1
    return df.withColumn("_place", place).join(parts, [*by, "_part"]).withColumn(out, F.col("_before") + F.col("_place")).drop("_order", "_part", "_place", "_before")


def _part_of(score: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are at or below a score, by binary search; 0 for null. The cuts travel with the function, not in the plan."""
    bounds = np.array(cuts)

    def run(values: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(bounds, values.fill_null(-np.inf).to_numpy(zero_copy_only=False), "right").astype(np.int32))

    return F.arrow_udf(run, "int")(score.cast("double"))


def prefix_sums(df: DataFrame, by: list[str], score: str, sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """df (a row for each value of `score` and group) with running sums from the highest score down.

    Two passes: sums within parts of the scores, cut at their quantiles so that none is crowded, and of whole parts before; a
    part is sorted by itself. df is read a few times, so it should be a table. parts: by default of about PART rows.
    """
    parts = parts_for(df.count()) if parts is None else parts
    cuts = sorted(set(df.approxQuantile(score, [k / parts for k in range(1, parts)], 1 / (4 * parts)))) if parts > 1 else []
    df = df.withColumn("_part", _part_of(F.col(score), cuts) if cuts else F.lit(0))
    own = Window.partitionBy(*by, "_part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({o: F.sum(c).over(own) for o, c in sums.items()})
    if not cuts:
        return out.drop("_part")
    earlier = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = earlier.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    whole = df.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_{o}") for o, c in sums.items()))
    whole = whole.select(*by, "_part", *(F.coalesce(F.sum(f"_{o}").over(earlier), F.lit(0)).alias(f"_{o}") for o in sums))
    out = out.join(F.broadcast(whole) if len(cuts) <= 1000 and not by else whole, [*by, "_part"])
    return out.withColumns({o: F.col(o) + F.col(f"_{o}") for o in sums}).drop("_part", *(f"_{o}" for o in sums))


def quantiles(counted: DataFrame, by: list[str], value: str, count: str, levels: tuple[float, ...]) -> DataFrame:
    """(*by, q): the values at the levels, linear between order statistics, of counted(*by, value, count), a row for each
    different value. Running counts find the two order statistics of each level; no group's values are gathered."""
    upto = prefix_sums(counted, by, value, {"_above": count})  # how many are as high or higher
    total = (counted.groupBy(*by) if by else counted.groupBy()).agg(F.sum(count).alias("_total"))
    if by:
        rows = upto.join(total, by)
    else:
        rows = upto.withColumn("_one", F.lit(1)).join(F.broadcast(total.withColumn("_one", F.lit(1))), "_one").drop("_one")
    first, last = F.col("_total") - F.col("_above"), F.col("_total") - F.col("_above") + F.col(count) - 1  # places from 0
    found = []
    for k, level in enumerate(levels):
        place = (F.col("_total") - 1) * F.lit(level)
        low = F.floor(place)
        share = place - low
        at = lambda p: (first <= p) & (p <= last)
        found.append((F.sum(F.when(at(low), F.col(value) * (1 - share)).otherwise(0.0)) + F.sum(F.when((share > 0) & at(low + 1), F.col(value) * share).otherwise(0.0))).alias(f"_q{k}"))
    out = (rows.groupBy(*by) if by else rows.groupBy()).agg(*found)
    return out.select(*by, F.array(*(F.col(f"_q{k}") for k in range(len(levels)))).alias("q"))

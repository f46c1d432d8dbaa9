"""Temperature mixing of sources to target weights, realised as budgeted block permutations.

Weights are shares of tokens to the power of an exponent a, normalised: w_i = n_i^a / sum n_j^a. a = 1 keeps the sources' own
shares, a = 0 makes them equal. The exponent is bisected to the flattest mixture that meets a limit: at most
`max_repeats` passes over any source (counted against the largest), or an entropy of at most `entropy` times the logarithm of the number of sources. The
budget is the tokens of the mixture; by default it is the least with which every source is seen once in full, so that
nothing is left out and small sources repeat.

Source i gets floor(w_i * budget) tokens. It gives whole passes over its documents, then a part of another one. A pass is a
permutation of blocks of documents: block and place within it come from a hash of seed, pass and document, so no source
is sorted in one task. Of the last pass, blocks are taken while their tokens fit in the remaining budget; of the first
block that does not fit, documents are taken in their order while they fit.

A null source is a source of its own, named ''. Tokens are words, runs of characters other than white space (0x20, 0x09-0x0D);
null and empty texts have none and are taken in every whole pass. Documents with equal ids, repeated rows among them, stay
next to each other in a permutation and are taken one by one. An empty table gives no rows. Extra columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import quoted, written

MAX_REPEATS = 4.0
BLOCK_DIGITS, BLOCK_ROWS = 2, 4096  # hexadecimal digits of a hash that number a block; rows of a part of a block, about
SMALL = 100_000  # rows of about 60 bytes that may be broadcast
STEPS, LARGEST = 60, 64.0
WORDS = r"[^\x20\x09-\x0D]+"


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def exponent(sizes: list[int], *, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None) -> float:
    """The exponent for sources of these sizes, all above 0."""
    if len(sizes) < 2:
        return 1.0
    logs = [math.log(x) for x in sizes]

    def spread(a: float) -> float:
        w = [math.exp(a * (x - max(logs))) for x in logs]
        total = math.fsum(w)
        return -math.fsum(x / total * math.log(x / total) for x in w) / math.log(len(w))

    return bisected(sizes, max_repeats, entropy, spread)


def bisected(sizes: list[int], max_repeats: float | None, entropy: float | None, spread: Callable[[float], float]) -> float:
    """The least exponent, to 2^-60 of its range, that meets the limits; sizes: the least and the largest will do; spread:
    entropy at an exponent, as a share of the largest possible. Above 1 where the sources' own shares have more entropy
    than asked for; LARGEST if nothing meets the limits."""
    logs = [math.log(x) for x in sizes]
    top = max(logs)

    def meets(a: float) -> bool:
        if max_repeats is not None and max((a - 1) * (x - top) for x in logs) > math.log(max_repeats):
            return False
        return entropy is None or spread(a) <= entropy

    if meets(0.0):
        return 0.0
    low, high = 0.0, 1.0
    while not meets(high) and high < LARGEST:
        low, high = high, 2 * high
    for _ in range(STEPS):
        middle = (low + high) / 2
        if meets(middle):
            high = middle
        else:
            low = middle
    return high


def plan(sizes: dict[str, int], *, budget: int | None = None, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None) -> tuple[float, dict[str, int]]:
    """The exponent, and tokens to take from each source. Rounded to 9 digits, so that the exponent can be recomputed."""
    some = {k: n for k, n in sizes.items() if n > 0}
    if not some:
        return 1.0, dict.fromkeys(sizes, 0)
    a = math.ceil(exponent(sorted(some.values()), max_repeats=max_repeats, entropy=entropy) * 1e9) / 1e9
    largest = max(some.values())
    powers = {k: (n / largest) ** a for k, n in some.items()}
    total = math.fsum(powers[k] for k in sorted(powers))
    # without a budget the largest source, which has the least passes, is seen once
    take = {k: math.floor(p * largest + 1e-6) if budget is None else math.floor(p / total * budget + 1e-6) for k, p in powers.items()}
    return a, {k: take.get(k, 0) for k in sizes}


def mix(docs: DataFrame, *, budget: int | None = None, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, seed: int = 0) -> DataFrame:
    """docs(doc_id, text, source, ...) with a row for each time a document is taken: its columns, then _tokens, _pass (from
    0), _block and _place, the order within the pass (names that docs has already are replaced)."""
    columns = [x for x in docs.columns if x not in ("_tokens", "_pass", "_block", "_place")]
    return taken(docs.select(*map(quoted, columns)), budget=budget, max_repeats=max_repeats, entropy=entropy, seed=seed).select("all.*", F.col("tokens").alias("_tokens"), F.col("pass").alias("_pass"), F.col("block").alias("_block"), F.col("place").alias("_place"))


def taken(docs: DataFrame, *, budget: int | None = None, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, seed: int = 0) -> DataFrame:
    """(all, tokens, pass, block, place) for each time a document is taken: all is a struct of the columns of docs, whatever
    their names."""
    docs = docs.select(F.struct("*").alias("all")).select("all", tokens(F.col("all.text")).alias("tokens"), F.coalesce(F.col("all.source"), F.lit("")).alias("source"))
    sizes = docs.groupBy("source").agg(F.sum("tokens").alias("n"), F.count("*").alias("rows"))
    sizes = written(sizes, "sources")
    seen = sizes.agg(F.count("*").alias("sources"), F.max("rows").alias("rows"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("low"), F.max("n").alias("top")).first()
    digits = block_digits(seen.rows or 0)
    weights = _weights(sizes, seen.low, seen.top or 0, budget, max_repeats, entropy)
    docs = docs.join(F.broadcast(weights) if seen.sources <= SMALL else weights, "source")
    full = docs.where("whole > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1))).withColumns(_order(seed))
    part = docs.where("room > 0").withColumn("pass", F.col("whole").cast("int")).withColumns(_order(seed))
    part = _fitting(part, digits, seen.sources * 16**digits <= SMALL)
    out = ["all", "tokens", "pass", "block", "place"]
    return full.select(*out).unionByName(part.select(*out))


def _weights(sizes: DataFrame, low: int | None, top: int, budget: int | None, max_repeats: float | None, entropy: float | None) -> DataFrame:
    """(source, whole, room): whole passes over each source, and tokens of another one. Only sums over sources come to the
    driver."""
    if not top:
        return sizes.select("source", F.lit(int(budget is None)).cast("long").alias("whole"), F.lit(0).cast("long").alias("room"))
    n = F.col("n").cast("double")

    def spread(a: float) -> float:
        """Entropy of the weights by the logarithm of the number of sources with tokens."""
        w = F.exp(F.lit(a) * (F.log(n) - math.log(top)))
        some = sizes.where("n > 0").select(w.alias("w")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.log("w")).alias("wl"), F.count("*").alias("k")).first()
        return (math.log(some.w) - some.wl / some.w) / math.log(some.k) if some.k > 1 else 0.0

    a = math.ceil(bisected([low, top], max_repeats, entropy, spread) * 1e9) / 1e9 if sizes.where("n > 0").limit(2).count() > 1 else 1.0
    power = F.pow(n / F.lit(float(top)), F.lit(a))
    total = None if budget is None else sizes.where("n > 0").agg(F.sum(power)).first()[0]
    # without a budget the largest source, which has the least passes, is seen once
    take = F.floor((power * F.lit(float(top)) if budget is None else power / F.lit(total) * F.lit(float(budget))) + 1e-6).cast("long")
    return sizes.select("source", F.when(n > 0, F.expr("n")).otherwise(0).alias("n"), F.when(n > 0, take).otherwise(0).alias("take")).selectExpr("source", f"if(n > 0, take div n, {int(budget is None)}) as whole", "if(n > 0, take % n, 0) as room")


def block_digits(rows: int) -> int:
    """Digits that number parts of blocks, so that the largest source has parts of about BLOCK_ROWS rows."""
    digits = BLOCK_DIGITS
    while rows > BLOCK_ROWS * 16**digits:
        digits += 1
    return digits


def _order(seed: int) -> dict[str, Column]:
    mixed = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pass").cast("string"), F.coalesce(F.col("all.doc_id").cast("string"), F.lit(""))).cast("binary"))
    return {"block": F.substring(mixed, 1, BLOCK_DIGITS), "place": F.substring(mixed, BLOCK_DIGITS + 1, 32)}


def _fitting(docs: DataFrame, digits: int, small: bool) -> DataFrame:
    """Rows of the first blocks of each source whose tokens fit in `room`, and those that fit of the next block. Large blocks are
    dealt in parts, numbered by `digits` digits, of which the same rows are taken."""
    docs = docs.withColumn("part", F.concat("block", F.substring("place", 1, digits - BLOCK_DIGITS)))
    parts = docs.groupBy("source", "block", "part").agg(F.sum("tokens").alias("n"), F.first("room").alias("left"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("used", before).withColumn("first", F.min("used").over(Window.partitionBy("source", "block")))
    parts = parts.where("first < left and used <= left").select("source", "part", "used", (F.col("used") + F.col("n") <= F.col("left")).alias("fits"))
    met = docs.join(F.broadcast(parts) if small else parts, ["source", "part"])
    order = Window.partitionBy("source", "part").orderBy("place", "all.doc_id", F.xxhash64("all.text")).rowsBetween(Window.unboundedPreceding, 0)
    cut = met.where("not fits").withColumn("sum", F.sum("tokens").over(order)).where(F.col("used") + F.col("sum") <= F.col("room")).drop("sum")
    return met.where("fits").unionByName(cut)


def duckdb_sql(max_repeats: float = MAX_REPEATS, seed: int = 0) -> str:
    """The rows (doc_id, source, n_tokens, pass, block, place) of mix() with default budget, in DuckDB."""
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(source, '') AS s, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::BIGINT AS t, text FROM documents),
z AS (SELECT s, sum(t)::BIGINT AS n FROM d GROUP BY s),
g AS (SELECT max(n)::DOUBLE AS top, min(n)::DOUBLE AS low, count(*) AS k FROM z WHERE n > 0),
b AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
  SELECT i + 1, CASE WHEN ((lo + hi) / 2 - 1) * (ln(low) - ln(top)) > ln({max_repeats}) THEN (lo + hi) / 2 ELSE lo END,
    CASE WHEN ((lo + hi) / 2 - 1) * (ln(low) - ln(top)) > ln({max_repeats}) THEN hi ELSE (lo + hi) / 2 END FROM b, g WHERE i < {STEPS}),
e AS (SELECT CASE WHEN k < 2 THEN 1.0 WHEN -(ln(low) - ln(top)) <= ln({max_repeats}) THEN 0.0 ELSE ceil(hi * 1e9) / 1e9 END AS a, top FROM b, g WHERE i = {STEPS}),
w AS (SELECT s, n, CASE WHEN n > 0 THEN floor(pow(n / top, a) * top + 1e-6)::BIGINT ELSE 0 END AS take FROM z, e),
p AS (SELECT s, CASE WHEN n > 0 THEN take // n ELSE 1 END AS whole, CASE WHEN n > 0 THEN take % n ELSE 0 END AS room FROM w),
f AS (SELECT d.*, unnest(range(0, whole)) AS pass, NULL::BIGINT AS room FROM d JOIN p USING (s) WHERE whole > 0),
l AS (SELECT d.*, whole AS pass, room FROM d JOIN p USING (s) WHERE room > 0),
o AS (SELECT *, md5('{seed}:' || pass || ':' || coalesce(doc_id::VARCHAR, '')) AS h FROM (SELECT * FROM f UNION ALL SELECT * FROM l)),
q AS (SELECT *, substr(h, 1, {BLOCK_DIGITS}) AS block, substr(h, {BLOCK_DIGITS + 1}) AS place FROM o),
k AS (SELECT s, block, sum(t) AS n FROM q WHERE room IS NOT NULL GROUP BY s, block),
u AS (SELECT s, block, n, coalesce(sum(n) OVER (PARTITION BY s ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM k),
r AS (SELECT q.*, used, u.n, sum(t) OVER (PARTITION BY q.s, q.block ORDER BY place, doc_id) AS upto FROM q JOIN u USING (s, block) WHERE room IS NOT NULL AND used < room)
SELECT doc_id, source, t AS n_tokens, pass::INTEGER AS pass, block, place FROM q WHERE room IS NULL
UNION ALL SELECT doc_id, source, t, pass::INTEGER, block, place FROM r WHERE used + n <= room OR used + upto <= room"""

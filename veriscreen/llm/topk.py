"""Exact top-k search: tiled matrix products of queries and shards, partial selection per tile, tree merging of top lists.

Vectors become integers, floor(scale * x) of each component x as a double; a score is the integer inner product of two vectors of equal
length. Equal rows are one class with a number, so a vector that fills a third of the table is one row from the first shuffle on. Classes are dealt by a hash
to shards, queries to blocks. In a tile of a block and a shard the block is held and the shard streams by, a few thousand vectors at a time: a
matrix product, of which each query's best k + 1 are selected and merged into its list. A tile gives a list a query; lists meet in a tree,
FAN at a time, until a query has one. No pair becomes a row, and no task sees more than FAN lists of a query.

Blocks and shards are about as large as each other, up to SIDE_BYTES, so both are copied about equally often: n rows and q queries move
2 * n * q / side vectors, and take n * q products, which is what was asked for.

Products are exact in the precision used: single where norms say that all partial sums stay below 2**24 (by Cauchy-Schwarz), double below
2**53, Python's integers beyond. Scores beyond 64 bits count as the largest or smallest long.

A query's own row is no candidate, a repeated row is: a list holds one item more than asked for, of which one with the query's id and its
inner product with itself goes. Vectors that are null or hold null or non-finite components take no part; vectors meet those of their own length only (empty
ones score 0). Ties go to the smaller id, null ids last; rows with null ids are no queries. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import trim

SCALE = 1024.0
SIDE_BYTES = 64 << 20  # of the queries of a tile, as doubles
LEAST_SHARD = 4096  # vectors, about
CELLS = 2048  # a product has as many rows and columns, at most
FAN = 16  # lists that are merged at once
PARTITIONS = 20_000  # that tiles are dealt to, at most: a partition may hold several
LONG = (1 << 63) - 1
ITEMS = "items array<struct<minus:bigint,unknown:boolean,id:bigint,n:bigint>>"
LIST = f"q long, vec_id long, own long, copies long, place long, {ITEMS}"


def quantised(flat: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles, which hold it exactly; beyond the range of doubles their largest."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(flat.astype(np.float64) * scale))


def exact_products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """a @ b.T of integers held as doubles, whose norms multiply to `bound` at most: in float32, float64 or int64, all exact."""
    if bound < 1 << 24:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if bound < 1 << 53:
        return a @ b.T
    whole = lambda x: np.array([[int(y) for y in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    exact = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.array([[max(-LONG, min(LONG, x)) for x in row] for row in exact.tolist()], np.int64).reshape(len(a), len(b))


def _norms(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((x * x).sum(axis=1)) * (1 + 1e-9)


def best(row: np.ndarray, minus: np.ndarray, unknown: np.ndarray, ids: np.ndarray, n: np.ndarray, k: int) -> list[np.ndarray]:
    """The k first items of each row, in order."""
    order = np.lexsort((ids, unknown, minus, row))
    row = row[order]
    starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1]))) if len(row) else np.zeros(0, np.int64)
    place = np.arange(len(row)) - np.repeat(starts, np.diff(np.append(starts, len(row))))
    order = order[place < k]
    return [row[place < k], *(x[order] for x in (minus, unknown, ids, n))]


class _Lists:
    """The top lists of some queries, and how good an item must be to enter one."""

    def __init__(self, queries: np.ndarray, k: int):
        self.x, self.k, self.norm = queries, k, float(_norms(queries).max(initial=0))
        self.items = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.enough = np.full(len(queries), -math.inf)

    def meet(self, ids: np.ndarray, unknown: np.ndarray, n: np.ndarray, x: np.ndarray) -> None:
        score = exact_products(self.x, x, self.norm * float(_norms(x).max(initial=0)))
        cut = self.enough
        if np.isneginf(cut).any() and x.shape[0] > self.k:
            cut = np.maximum(cut, np.partition(score, x.shape[0] - self.k, axis=1)[:, x.shape[0] - self.k])  # k items reach it
        cut = np.nextafter(cut.astype(np.float32), np.float32(-math.inf)) if score.dtype != np.float64 else cut  # not above the cut itself
        row, column = np.nonzero(score >= cut[:, None])
        if len(row):
            own = [row, -score[row, column].astype(np.int64), unknown[column], ids[column], n[column]]
            self.items = best(*(np.concatenate(z) for z in zip(self.items, own)), self.k)
            full = np.flatnonzero(np.bincount(self.items[0], minlength=len(self.x)) == self.k)
            last = np.cumsum(np.bincount(self.items[0], minlength=len(self.x)))[full] - 1
            self.enough[full] = -self.items[1][last].astype(np.float64)


def _tiles(dim: int, k: int, scale: float, blocks: int):
    """Lists of the queries (side 0) of each tile among its vectors (side 1), which follow them."""

    def columns(batch: pa.RecordBatch) -> tuple:
        ids = batch.column(2)
        x = quantised(batch.column(5).flatten().to_numpy(zero_copy_only=False), scale).reshape(-1, dim) if dim else np.zeros((batch.num_rows, 0))
        return ids.fill_null(LONG).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), batch.column(3).to_numpy(), batch.column(4).to_numpy(zero_copy_only=False), x

    def finished(tile: int, held: list, lists: list[_Lists]) -> Iterator[pa.RecordBatch]:
        q, ids, copies = (np.concatenate([h[j] for h in held]) for j in (4, 0, 2))
        at = 0
        for own in lists:
            count = np.bincount(own.items[0], minlength=len(own.x))
            fine = np.flatnonzero(count)
            if len(fine):
                product = np.array([int(exact_products(y[None], y[None], float(_norms(y[None])[0]) ** 2)[0, 0]) for y in own.x[fine]])
                struct = pa.StructArray.from_arrays([pa.array(own.items[1]), pa.array(own.items[2]), pa.array(own.items[3], mask=own.items[2]), pa.array(own.items[4])], ["minus", "unknown", "id", "n"])
                offsets = np.concatenate(([0], np.cumsum(count[fine]))).astype(np.int32)
                which = at + fine
                yield pa.RecordBatch.from_arrays([pa.array(q[which]), pa.array(ids[which]), pa.array(product), pa.array(copies[which]), pa.array(np.full(len(fine), tile // blocks)), pa.ListArray.from_arrays(offsets, struct)], ["q", "vec_id", "own", "copies", "place", "items"])
            at += len(own.x)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, lists = None, [], None
        for batch in batches:
            to, side = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero((to[1:] != to[:-1]) | (side[1:] != side[:-1])) + 1).tolist(), len(to)] if len(to) else []
            for a, b in zip(edges[:-1], edges[1:]):
                if to[a] != tile:
                    if lists:
                        yield from finished(tile, held, lists)
                        trim()
                    tile, held, lists = int(to[a]), [], None
                own = columns(batch.slice(a, b - a))
                if side[a] == 0:
                    held.append((*own[:3], own[4], own[3]))
                    continue
                if not held:
                    continue  # a shard that a block without queries meets
                if lists is None:
                    x = np.concatenate([h[3] for h in held])
                    held = [(h[0], h[1], h[2], None, h[4]) for h in held]
                    lists = [_Lists(x[i : i + CELLS], k) for i in range(0, len(x), CELLS)]
                ids, unknown, n, _, x = own
                for i in range(0, len(x), CELLS):
                    for part in lists:
                        part.meet(ids[i : i + CELLS], unknown[i : i + CELLS], n[i : i + CELLS], x[i : i + CELLS])
        if lists:
            yield from finished(tile, held, lists)
        trim()

    return run


def classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding, n) of the different rows that take part, and how many there are of each."""
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding") if kind == "float" else F.col("embedding").cast("array<double>").alias("embedding"))
    own = own.where("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return own.groupBy("vec_id", "embedding").agg(F.count("*").alias("n"))


def merged(lists: DataFrame, places: int, k: int) -> DataFrame:
    """Lists of (q, place) to one a query: FAN places become one, until one is left."""
    while True:
        places = -(-places // FAN)
        items = F.slice(F.sort_array(F.flatten(F.collect_list("items"))), 1, k)
        lists = lists.groupBy("q", "vec_id", "own", "copies", F.floor(F.col("place") / FAN).alias("place")).agg(items.alias("items"))
        if places <= 1:
            return lists


def _lists(own: DataFrame, queries: DataFrame, dim: int, n: int, asked: int, k: int, scale: float, side_bytes: int, least_shard: int) -> DataFrame:
    side = max(1, side_bytes // (8 * max(1, dim)))
    blocks = -(-asked // side)
    shards = -(-n // max(least_shard, min(side, asked)))
    copied = lambda j, m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(j)
    spread = lambda m, *c: F.pmod(F.xxhash64(*c), F.lit(m)).cast("long")
    vectors = own.select(spread(shards, "vec_id", "embedding").alias("shard"), copied("block", blocks), F.lit(1).alias("side"), "vec_id", "n", F.lit(0).cast("long").alias("q"), "embedding")
    asking = queries.select(copied("shard", shards), spread(blocks, "q").alias("block"), F.lit(0).alias("side"), "vec_id", "n", "q", "embedding")
    rows = vectors.unionByName(asking).select((F.col("shard") * blocks + F.col("block")).alias("tile"), "side", "vec_id", "n", "q", "embedding")
    parts = min(PARTITIONS, blocks * shards)
    rows = rows.repartitionById(parts, F.pmod(F.col("tile"), F.lit(parts)).cast("int")).sortWithinPartitions("tile", "side", "q", "vec_id")
    return merged(rows.mapInArrow(_tiles(dim, k + 1, scale, blocks), LIST), shards, k + 1)


def search(vectors: DataFrame, asks: Column | None = None, *, k: int = 10, scale: float = SCALE, side_bytes: int = SIDE_BYTES, least_shard: int = LEAST_SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of vectors(vec_id, embedding) for each row for which `asks`, a condition
    on vec_id, holds (default: every row)."""
    spark = vectors.sparkSession
    own = written(classes(vectors), "topk-vectors")
    asks = F.col("vec_id").isNotNull() & F.coalesce(F.lit(True) if asks is None else asks, F.lit(False))
    queries = written(own.where(asks).withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    size, found = F.size("embedding").alias("dim"), None
    counts = own.groupBy(size).agg(F.count("*").alias("n")).join(queries.groupBy(size).agg(F.count("*").alias("asked")), "dim")
    for dim, n, asked in counts.orderBy("dim").collect():  # a row for each length of vectors
        part = _lists(own.where(F.size("embedding") == dim), queries.where(F.size("embedding") == dim), dim, n, asked, k, scale, side_bytes, least_shard)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    itself = F.expr("array_position(transform(items, x -> not x.unknown and x.id = vec_id and x.minus = -own), true) - 1")
    left = F.expr("transform(items, (x, i) -> named_struct('id', x.id, 'score', -x.minus, 'n', x.n - if(i = itself, 1, 0)))")
    each = F.expr(f"slice(flatten(transform(items, x -> array_repeat(struct(x.id, x.score), cast(least(x.n, {k}) as int)))), 1, {k})")
    out = found.withColumn("itself", itself).withColumn("items", left).withColumn("items", each)
    out = out.select(F.col("vec_id").alias("query_id"), "items", F.explode(F.expr("sequence(1L, copies)")))
    out = out.select("query_id", F.posexplode("items").alias("rank", "x"))
    return out.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.score").alias("score"))


DUCKDB_SQL = """WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding::DOUBLE[], lambda x: floor(1024 * x)) AS e FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
k AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM k WHERE rank <= 10"""

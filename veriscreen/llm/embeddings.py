"""Near-duplicate embeddings: cross-polytope hashing after fast Hadamard rotations, multiprobe, verified pairs.

A hash of a vector is the nearest signed axis after a random rotation (three rounds of random signs and a fast Walsh-Hadamard
transform, over the dimension padded to a power of two). `k` of them make a bucket; each of `tables` tables has its own
rotations. A vector is stored in its own bucket and looks into the `probes` buckets that are cheapest to reach from it, of
which its own is the first.

What goes to buckets is small: number of the bucket and of the vector, and a sketch of SKETCH signs of random projections, of
which two vectors with cosine c differ in a share of acos(c) / pi. Members of a bucket whose sketches differ in no more than
five standard deviations above that share for the cosine asked for (a linked pair differs in more with a chance below
1e-6) are candidates. Candidates join into families, and only then vectors move: in tiles of a family all pairs are
verified by cosine in double precision, each in one tile. No pair becomes a row: a tile gives each vector's number of
links, and the least vector connected to it.

k grows with the logarithm of the number of vectors, so buckets stay small; tables follow from k, so that a pair with a
cosine of 0.9 is missed with a chance of about `miss` (a pair with 0.95 with less than a tenth of that). Nothing is
capped: a bucket with more than `tile` members, or a family, is compared in pairs of tiles, spread over tasks.

Equal vectors are one class: they go through the tables once and count with their number. Vectors that are null, empty or
zero, or hold null or non-finite components, link with nothing; vectors link with those of their own length only. Rows
with a null vec_id link with nothing and have no component. A repeated row is another vector: it links with its copies.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .post import runs
from .shared import components, forget, written
from .words import trim

COSINE = 0.9
PROBES = 4
MISS = 5e-4
TILE = 1024
#: Chance that a pair with cosine 0.9 meets in a table, for k = 1, 2, 3, 4 and 4 probes: measured in 64 dimensions, and rounded down from
#: about 700 to 3000 measured pairs and tables in more. Fewer dimensions have higher chances.
MEETS = {
    64: (0.92, 0.61, 0.33, 0.18), 128: (0.89, 0.54, 0.27, 0.13), 256: (0.86, 0.48, 0.22, 0.095), 512: (0.83, 0.42, 0.18, 0.07),
    1024: (0.79, 0.36, 0.14, 0.05), 2048: (0.72, 0.31, 0.11, 0.035), 4096: (0.70, 0.29, 0.09, 0.025),
}
FARTHER = (0.95, 0.85, 0.8, 0.7)  # factors of the chances with each doubling beyond the table, about those within it
TOP = 4  # axes of each hash that probes are made from
SKETCH = 192  # signs of a sketch
SMALL = 64  # members of a bucket whose pairs are compared in one go with those of other buckets


def fwht(x: np.ndarray) -> np.ndarray:
    """Orthonormal fast Walsh-Hadamard transform of each row; the length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def probes_of(x: np.ndarray, tables: int, k: int, probes: int, seed: int = 7) -> np.ndarray:
    """(vectors, tables, probes) bucket numbers, the own bucket first."""
    n, dim = x.shape
    d = 1 << max(1, (dim - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - dim)))
    top = min(TOP, d)
    combos = np.array(list(itertools.product(range(top), repeat=k)))
    combos = combos[np.argsort(combos.sum(axis=1), kind="stable")]
    probes = min(probes, len(combos))
    rng = np.random.default_rng([seed, d])
    out = np.empty((n, tables, probes), np.int64)
    for t in range(tables):
        code, cost = np.zeros((n, len(combos)), np.int64), np.zeros((n, len(combos)))
        for j in range(k):
            y = x
            for _ in range(3):
                y = fwht(y * rng.choice([-1.0, 1.0], d))
            size = np.abs(y)
            axes = np.argsort(-size, axis=1, kind="stable")[:, :top]
            value = np.take_along_axis(size, axes, 1)
            signed = 2 * axes + (np.take_along_axis(y, axes, 1) < 0)
            code = code * (2 * d) + signed[:, combos[:, j]]
            cost += ((value[:, :1] - value) ** 2)[:, combos[:, j]]
        cheapest = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(code, cheapest, 1)
    return out


def sizes_for(n: int, dim: int, miss: float = MISS) -> tuple[int, int]:
    """k and tables for n vectors."""
    d = 1 << max(1, (dim - 1).bit_length())
    k = min(len(FARTHER), max(1, math.ceil(math.log(max(n, 64) / 64) / math.log(2 * d))))
    known = min(max(d, min(MEETS)), max(MEETS))
    meets = MEETS[known][k - 1] * FARTHER[k - 1] ** max(0, (d // known).bit_length() - 1)
    return k, math.ceil(math.log(miss) / math.log(1 - meets))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sketches(x: np.ndarray, seed: int = 11) -> np.ndarray:
    """(vectors, SKETCH / 64) of the signs of random projections. They are dense: rotations by Hadamard transforms leave
    exact zeros of vectors with few different components, whose signs mean nothing."""
    planes = np.random.default_rng([seed, x.shape[1]]).normal(size=(x.shape[1], SKETCH))
    return np.packbits(x @ planes > 0, axis=1).view(np.int64)


def most_apart(cosine: float) -> int:
    """Signs in which the sketches of candidates differ, at most."""
    share = math.acos(min(1.0, max(-1.0, cosine))) / math.pi
    return math.ceil(SKETCH * share + 5 * math.sqrt(SKETCH * share * (1 - share)))


_WORDS = [f"s{j}" for j in range(SKETCH // 64)]
ENTRY = "bucket long, node long, own boolean, " + ", ".join(f"{x} long" for x in _WORDS)


def _entries(k: int, tables: int, probes: int, dim: int):
    """Rows (bucket, node, own, sketch) of each class: one for every table and probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                x = _unit(part.column(1).flatten().to_numpy().reshape(-1, dim))
                codes = probes_of(x, tables, k, probes)
                n, _, width = codes.shape
                table = np.broadcast_to(np.arange(tables)[None, :, None], codes.shape)
                bucket = (codes * tables + table).reshape(-1)
                take = np.repeat(np.arange(n), tables * width)
                own = np.tile(np.arange(width) == 0, n * tables)
                sketch = sketches(x)[take]
                yield pa.RecordBatch.from_arrays([pa.array(bucket), part.column(0).take(pa.array(take)), pa.array(own), *(pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(len(_WORDS)))], ["bucket", "node", "own", *_WORDS])
            trim()

    return run


def _least(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least that the links (a, b) connect it with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        if (label[a] == low).all() and (label[b] == low).all():
            break
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
    return label


def _candidates(most: int):
    """Links (a, b) between the candidates of each run of equal addresses, enough to connect them."""

    def near(sketch: np.ndarray, a, b) -> np.ndarray:
        return np.bitwise_count((sketch[a] ^ sketch[b]).view(np.uint64)).sum(axis=-1, dtype=np.int64) <= most

    def solve(to, node, looks, stored, sketch) -> Iterator[pa.RecordBatch]:
        n = len(to)
        starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
        size = np.diff(np.append(starts, n))
        little = np.repeat(size <= SMALL, size)
        after = np.where(little, np.repeat(starts + size, size) - np.arange(n) - 1, 0)
        links: list[tuple] = []
        cuts = np.searchsorted(np.cumsum(after), np.arange(1 << 20, int(after.sum()) + (1 << 20), 1 << 20), "right") if after.sum() else []
        first = 0
        for last in [*cuts, n] if after.sum() else []:  # about a million pairs at once
            own = np.arange(first, min(int(last) + 1, n))
            first = int(own[-1]) + 1 if len(own) else first
            a = np.repeat(own, after[own])
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after[own]) - after[own], after[own])
            fine = (stored[a] & looks[b]) | (stored[b] & looks[a])
            a, b = a[fine], b[fine]
            fine = near(sketch, a, b)
            links.append((a[fine], b[fine]))
        for k in np.flatnonzero(size > SMALL).tolist():
            run = slice(starts[k], starts[k] + size[k])
            x, y = starts[k] + np.flatnonzero(stored[run]), starts[k] + np.flatnonzero(looks[run])
            for at in range(0, len(x), 256):
                p, q = np.nonzero(near(sketch, x[at : at + 256][:, None], y[None, :]))
                p, q = _reduced(n, x[at + p], y[q])
                links.append((p, q))
        if links:
            a, b = (np.concatenate([z[j] for z in links]) for j in (0, 1))
            label = _least(n, a, b)
            other = np.flatnonzero(node != node[label])
            if len(other):
                pairs = np.unique(np.column_stack((node[other], node[label[other]])), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            own = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), *(batch.column(j).to_numpy(zero_copy_only=False) for j in (2, 3)), np.column_stack([batch.column(4 + j).to_numpy() for j in range(len(_WORDS))])]
            held = [np.concatenate(x) for x in zip(held, own)] if held else own
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0  # the last run may go on
            if cut:
                yield from solve(*(x[:cut] for x in held))
                held = [x[cut:].copy() for x in held]
                trim()
        if held and len(held[0]):
            yield from solve(*held)
        trim()

    return run


def _reduced(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links that connect the same places."""
    if len(a) < n:
        return a, b
    label = _least(n, a, b)
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


WHOLE, BOTH, LEFT, RIGHT = range(4)


def _verified(cosine: float):
    """Tiles of families: (node, whole, other, n_links) of the vectors that link: other is the least one connected to it."""

    def solve(members: list[tuple], whole: bool) -> Iterator[pa.RecordBatch]:
        side, family, node, weight = (np.array([x[k] for x in members]) for k in range(4))
        by_size: dict[int, list[int]] = {}
        for i, x in enumerate(members):
            by_size.setdefault(len(x[4]), []).append(i)
        total, links = np.zeros(len(node), np.int64), []
        for own in by_size.values():
            which = np.array(own)
            u = _unit(np.array([members[i][4] for i in own]))
            for at in range(0, len(which), 256):
                p, q = np.nonzero(u[at : at + 256] @ u.T >= cosine)
                p, q = which[at + p], which[q]
                fine = (p < q) & (family[p] == family[q]) & ((side[p] != side[q]) | (side[p] < LEFT))
                p, q = p[fine], q[fine]
                total += np.bincount(p, weight[q], len(node)).astype(np.int64) + np.bincount(q, weight[p], len(node)).astype(np.int64)
                links.append(_reduced(len(node), p, q))
        a, b = (np.concatenate([x[k] for x in links]) for k in (0, 1))
        label = _least(len(node), a, b)
        low = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(low, label, node)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(node[own]), pa.array(np.full(len(own), whole)), pa.array(low[label[own]]), pa.array(total[own])], ["node", "whole", "other", "n_links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for _, rows in runs(batches):
            members = [(side, family, node, weight, np.frombuffer(vector, "<f8")) for side, family, node, weight, vector in rows]
            if members[0][0] == WHOLE:
                held += members
                if len(held) >= TILE:
                    yield from solve(held, True)
                    held = []
                    trim()
            elif len(members) > 1:
                yield from solve(members, False)
                trim()
        if held:
            yield from solve(held, True)
        trim()

    return run


def classes(vectors: DataFrame) -> DataFrame:
    """(node, n, embedding) of the different usable vectors: node is the smallest vec_id that has it, n how many rows."""
    fine = F.expr("vec_id is not null and embedding is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    return vectors.where(fine).groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("n"))


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE, probes: int = PROBES, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding") if _is_float(vectors) else F.col("embedding").cast("array<double>").alias("embedding"))
    own = written(classes(vectors), "vector-classes")
    found = None
    for dim, n in own.groupBy(F.size("embedding")).count().orderBy("count").collect():  # a row for each length of vectors
        part = _links(own.where(F.size("embedding") == dim), n, dim, cosine, probes, miss, tile)
        found = part if found is None else found.union(part)
    families = components(found if found is not None else spark.createDataFrame([], "a long, b long")).toDF("node", "family")
    tiles = _tiled(own.join(families, "node"), tile)
    links = written(tiles.mapInArrow(_verified(cosine), "node long, whole boolean, other long, n_links long"), "vector-links")
    parts = components(links.where("not whole").select(F.col("node").alias("a"), F.col("other").alias("b"))).toDF("node", "component")
    labels = links.where("whole").select("node", F.col("other").alias("component")).union(parts)
    degree = links.groupBy("node").agg(F.sum("n_links").alias("links"))
    named = own.join(degree, "node", "left").join(labels, "node", "left").select("embedding", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = vectors.join(named.where("n_links > 0"), ["embedding"], "left")
    linked = F.col("vec_id").isNotNull()
    component = F.when(linked, F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce(F.when(linked, F.col("n_links")), F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _tiled(members: DataFrame, tile: int) -> DataFrame:
    """(to, side, family, node, n, vector) of members(family, node, n, embedding) for each tile that they belong to: a family of
    up to `tile` is a tile of its own, a larger one is cut into parts of which each two are one."""
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / tile).cast("int").alias("m"))
    members = members.join(sizes, "family").withColumn("mine", F.expr("cast(pmod(xxhash64(node), m) as int)")).withColumn("with", F.explode(F.expr("sequence(0, m - 1)")))
    side = F.when(F.col("m") == 1, WHOLE).when(F.col("with") == F.col("mine"), BOTH).when(F.col("mine") < F.col("with"), LEFT).otherwise(RIGHT)
    to = F.when(F.col("m") == 1, F.col("family")).otherwise(F.xxhash64("family", F.least("mine", "with"), F.greatest("mine", "with")))
    rows = members.select(to.alias("to"), side.alias("side"), "family", "node", "n", _packed(F.col("embedding")).alias("vector"))
    return rows.repartition(F.xxhash64("to")).sortWithinPartitions("to", "side", "node")


def _packed(vector: Column) -> Column:
    """A vector's components as doubles, little-endian."""

    def run(values: pa.Array) -> pa.Array:
        flat, at = values.flatten().to_numpy(zero_copy_only=False).astype("<f8"), values.offsets.to_numpy() - values.offsets[0].as_py()
        raw = flat.tobytes()
        return pa.array([raw[8 * x : 8 * y] for x, y in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())

    return F.arrow_udf(run, "binary")(vector)


def _links(own: DataFrame, n: int, dim: int, cosine: float, probes: int, miss: float, tile: int) -> DataFrame:
    """Links (a, b) that connect candidates."""
    k, tables = sizes_for(n, dim, miss)
    keys = written(own.select("node", "embedding").mapInArrow(_entries(k, tables, probes, dim), ENTRY), "vector-buckets")
    hot = keys.groupBy("bucket").agg(F.count("*").alias("members")).where(F.col("members") > tile)
    hot = written(hot.select("bucket", F.ceil(F.col("members") / tile).cast("int").alias("m")), "hot-buckets")  # Spark broadcasts it below its size threshold only
    cold = keys.join(hot, "bucket", "left_anti").select(F.col("bucket").alias("to"), "node", F.lit(True).alias("looks"), F.col("own").alias("stored"), *_WORDS)
    mine = "cast(pmod(xxhash64(node), m) as int)"
    cells = F.expr(
        f"concat(if(own, transform(sequence(0, m - 1), j -> named_struct('i', {mine}, 'j', j, 'stored', true, 'looks', false)), cast(array() as array<struct<i:int,j:int,stored:boolean,looks:boolean>>)), "
        f"transform(sequence(0, m - 1), i -> named_struct('i', i, 'j', {mine}, 'stored', false, 'looks', true)))"
    )
    split = keys.join(hot, "bucket").withColumn("cell", F.explode(cells)).select(F.xxhash64("bucket", "cell.i", "cell.j").alias("to"), "node", "cell.looks", "cell.stored", *_WORDS)
    dealt = cold.union(split).repartition(F.xxhash64("to")).sortWithinPartitions("to", "node")
    found = written(dealt.mapInArrow(_candidates(most_apart(cosine)), "a long, b long"), "candidates")
    forget(keys)
    return found


def _is_float(vectors: DataFrame) -> bool:
    return vectors.schema["embedding"].dataType.elementType.typeName() == "float"


DUCKDB_SQL = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, row_number() OVER () AS r FROM embeddings),
f AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 AND vec_id IS NOT NULL),
l AS (SELECT x.vec_id AS a, y.vec_id AS b FROM f x JOIN f y ON x.r <> y.r AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.9),
c AS (SELECT vec_id AS node, vec_id AS root FROM f UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.node),
m AS (SELECT node, min(root) AS component FROM c GROUP BY node),
d AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, coalesce(m.component, v.vec_id) AS component_id, coalesce(coalesce(m.component, v.vec_id) = v.vec_id, false) AS kept
FROM v LEFT JOIN d ON d.a = v.vec_id LEFT JOIN m ON m.node = v.vec_id"""

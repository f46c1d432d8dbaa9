"""Benchmark decontamination: MinHash containment search with partitions by size, verified by exact containment.

A test item is a few dozen words, a document up to tens of thousands, so their Jaccard similarity says nothing. Items are
partitioned by the size of their shingle sets (powers of two), and for each partition a document is looked at in windows
of twice the partition's largest size, which overlap by half: within a window that holds most of an item the similarity
is high whatever the document's length. Item and window are candidates if one of `hashes` MinHash values agrees (bands
of one row, so that a containment of 0.75 in a window is missed with a chance below 1e-5), and candidates are verified
by exact containment of the item's shingles in the document's. Scattered shingles of an item count too, since
verification takes the whole document.

A window's value can agree with an item's only if the window holds the very shingle that gave the item's value. So only
windows around such shingles are evaluated: the same candidates, at the cost of one look-up a shingle.

The index of the items is broadcast in parts of at most `part_bytes`, one pass over the documents each, and a part is let go
before the next is made; documents are never shuffled. Null and empty texts hold nothing and no item of theirs is found anywhere. Items or documents with fewer
than `width` words have their whole word sequence as only shingle; with `short_runs`, such an item's is looked up among a
document's runs of that many words. Repeated items and rows each get their own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import gram_codes, mix, shingle_sets, slices, trim, word_codes

WIDTH = 5
CONTAINMENT = (3, 4)  # shared shingles / shingles of the item, at least
HASHES = 48
PART_BYTES = 32 << 20
FOUND = "doc_id long, item_id long, n_shared long, n_item long"

_SEEDS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


class Index:
    """Items' shingle sets and MinHash values, for partitions by size."""

    def __init__(self, item_ids: list, sets: list[np.ndarray], hashes: int, lengths: list[int]):
        """lengths: numbers of words of the items that are looked up as runs, else 0."""
        self.item_ids, self.sets, self.hashes = item_ids, sets, hashes
        sizes = np.array([len(x) for x in sets])
        self.bounds = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64)  # largest size of each one's partition
        rows = []  # (shingle that gives the value, hash, item)
        for item, x in enumerate(sets):
            if len(x) and not lengths[item]:
                values = mix(x[None, :] * _SEEDS[:hashes, None])
                rows += [(x[k], h, item) for h, k in enumerate(values.argmin(axis=1))]
        rows.sort(key=lambda r: int(r[0]))
        self.shingles = np.array([r[0] for r in rows], np.uint64)
        self.runs = {n: [item for item, m in enumerate(lengths) if m == n] for n in sorted(set(lengths)) if n}
        self.hash, self.item = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))

    def candidates(self, grams: np.ndarray) -> list[int]:
        """Items of which some value agrees with that of a window of the document's shingles (in text order)."""
        if not len(self.shingles):
            return []
        low = np.searchsorted(self.shingles, grams)
        at = np.flatnonzero(self.shingles[np.minimum(low, len(self.shingles) - 1)] == grams)
        found: set[int] = set()
        for place, first in zip(at.tolist(), low[at].tolist()):
            last = first
            while last < len(self.shingles) and self.shingles[last] == grams[place]:
                if (item := int(self.item[last])) not in found and self._agrees(grams, place, int(self.hash[last]), int(self.bounds[item])):
                    found.add(item)
                last += 1
        return sorted(found)

    def _agrees(self, grams: np.ndarray, place: int, h: int, bound: int) -> bool:
        """Whether the shingle at place has the least value of hash h in one of the two windows that hold it."""
        window = 2 * bound
        last = place // bound * bound
        for start in (last - bound, last):
            values = mix(grams[max(0, start) : start + window] * _SEEDS[h])
            if values.min() == mix(grams[place : place + 1] * _SEEDS[h])[0]:
                return True
        return False


def find(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, containment: tuple[int, int] = CONTAINMENT, hashes: int = HASHES, part_bytes: int = PART_BYTES, short_runs: bool = False) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): items of benchmark(item_id, text) of whose shingles a document of
    docs(doc_id, text) holds the given share or more. Words are lower-cased in A-Z."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    parts = _indexes(benchmark, width, hashes, part_bytes, short_runs)
    index, out = next(parts, None), None
    while index is not None:
        held = spark.sparkContext.broadcast(index)  # part_bytes at most, but for a single larger item
        found, index = docs.mapInArrow(_finder(held, width, containment), FOUND), next(parts, None)
        if index is not None or out is not None:  # of several parts one is held at a time
            found = written(found, "found")
            held.destroy()
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], FOUND)


def _indexes(benchmark: DataFrame, width: int, hashes: int, part_bytes: int, short_runs: bool) -> Iterator[Index]:
    """The items in parts, read one partition at a time so that the driver holds a part at most."""
    ids, sets, lengths, size = [], [], [], 0
    for item_id, text in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        codes, counts = word_codes([text], True)
        own = next(shingle_sets(codes, counts, width))
        if not len(own):
            continue
        ids.append(item_id)
        sets.append(own)
        lengths.append(len(codes) if short_runs and len(codes) < width else 0)
        size += 8 * len(own) + 24 * hashes
        if size >= part_bytes:
            yield Index(ids, sets, hashes, lengths)
            ids, sets, lengths, size = [], [], [], 0
    if ids:
        yield Index(ids, sets, hashes, lengths)


def _finder(held, width: int, containment: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = held.value
        num, den = containment
        for batch in batches:
            for a, b in slices(batch.column(1)):
                doc_ids, rows = batch.column(0).slice(a, b - a).to_pylist(), []
                codes, counts = word_codes(batch.column(1).slice(a, b - a).to_pylist(), True)
                grams, start = gram_codes(codes, width), 0
                runs = [(n, items, np.concatenate([index.sets[k] for k in items]), gram_codes(codes, n)) for n, items in index.runs.items()]
                for doc_id, n in zip(doc_ids, counts.tolist()):
                    own = grams[start : start + n - width + 1] if n >= width else gram_codes(codes[start : start + n], n) if n else grams[:0]
                    for length, items, wanted, all_runs in runs:
                        held_items = np.flatnonzero(np.isin(wanted, all_runs[start : start + n - length + 1])) if n >= length else ()
                        rows += [(doc_id, index.item_ids[items[k]], 1, 1) for k in held_items]
                    start += n
                    for item in index.candidates(own):
                        shared = int(np.isin(index.sets[item], own).sum())
                        if shared * den >= num * len(index.sets[item]):
                            rows.append((doc_id, index.item_ids[item], shared, len(index.sets[item])))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], ["doc_id", "item_id", "n_shared", "n_item"])
            del batch
            trim()

    return run


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without rows that hold a benchmark item; rows with a null id are told by their text alone. Other columns pass
    through, whatever their names."""
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    hit = find(keyed, benchmark, **options).select(F.col("doc_id").alias("row")).distinct()
    own = docs.select(F.struct("*").alias("all")).withColumn("row", F.xxhash64("all.doc_id", "all.text"))
    return own.join(hit, "row", "left_anti").select("all.*")


#: With short_runs.
DUCKDB_SQL = r"""WITH w AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS g FROM w WHERE len(w) >= 5),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id),
few AS (SELECT id, len(w) AS m, array_to_string(w, ' ') AS g FROM w WHERE kind = 'i' AND len(w) BETWEEN 1 AND 4),
runs AS (SELECT DISTINCT id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i+m-1], ' '))) AS g FROM w, (SELECT DISTINCT m FROM few) WHERE kind = 'd' AND len(w) >= m)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared, any_value(n.n) AS n_item
FROM s d JOIN s i ON d.g = i.g JOIN n ON n.id = i.id WHERE d.kind = 'd' AND i.kind = 'i'
GROUP BY d.id, i.id HAVING 4 * count(*) >= 3 * any_value(n.n)
UNION ALL SELECT runs.id, few.id, 1, 1 FROM runs JOIN few USING (m, g)"""

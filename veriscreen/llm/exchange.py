"""Questions from blocks of documents to buckets of codes, and the answers back, without moving the documents.

A block is a part of one partition of the input, kept as it is read: the documents of a block stay where they are, while compact
arrays travel. A block first merges its own repeats, so that the most frequent code in the corpus reaches its bucket
once a block, not once an occurrence; buckets are chosen by a hash of the code, so that none is hot. Answers go back
to the block's partition, where one narrow zip joins them to its documents.

DataFrames have no narrow zip of two plans (a join would shuffle all texts for each question), so this module uses RDDs.
Questions whose answers need no text use the DataFrame messages of post.py instead.
Everything is recomputed from lineage when an executor is lost: a block is a pure function of its input split.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark import RDD
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted
from .words import trim

SPLIT = 16 << 20  # bytes of a partition's input at most, where row groups allow it
PARTS = 16  # blocks of a partition: each is sent to Python, and worked on, by itself
_ONE = BatchedSerializer(CPickleSerializer(), 1)


class Blocks:
    """The rows of df as `parts` elements a partition, each (block, rows as tuples); the last column of df is the text."""

    def __init__(self, df: DataFrame, parts: int = PARTS):
        self.spark, self.parts = df.sparkSession, parts
        key, conf = "spark.sql.files.maxPartitionBytes", self.spark.conf
        old = conf.get(key)
        try:
            jvm = self.spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils
            if jvm.byteStringAsBytes(old) > SPLIT:
                conf.set(key, str(SPLIT))
            if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
                df = df.sortWithinPartitions(*map(quoted, df.columns))  # rows of a shuffle may come in another order when read again
            sizes = df.groupBy(F.spark_partition_id()).agg(F.sum(F.coalesce(F.octet_length(df.columns[-1]), F.lit(0)) + 1)).collect()  # a number a partition
            rows = df.rdd
            self.size = rows.getNumPartitions()
        finally:
            conf.set(key, old)
        if not self.size:
            rows, self.size = self.spark.sparkContext.parallelize([], 1), 1
        self.bytes = sum(n for _, n in sizes)
        steps = {part: -(-n // parts) for part, n in sizes}
        self.rdd = rows.mapPartitionsWithIndex(lambda part, it: _gather(part, it, steps.get(part, SPLIT), parts))
        self._home: dict[tuple[RDD, ...], RDD] = {}
        self._zipped: dict[tuple[RDD, ...], RDD] = {}

    def buckets(self, share: int = 1 << 23) -> int:
        """One for each `share` bytes of text, so that a bucket's part stays the same as the corpus grows."""
        return max(8, self.bytes // share)

    def ask(self, request: Callable, answer: Callable, buckets: int, *known: RDD) -> RDD:
        """request(block, rows, *answers known) yields (bucket, payload); answer(bucket, [(block, payload)]) yields
        (block, payload). Returns those answers; zipped() brings them home."""

        def send(x):
            block, rows, got = x
            return ((bucket, (block, payload)) for bucket, payload in request(block, rows, *got))

        def reply(bucket: int, it: Iterable) -> Iterator:
            yield from answer(bucket, [x for _, x in it])
            trim()

        return self.each(send, *known).partitionBy(buckets, int).mapPartitionsWithIndex(reply)

    def each(self, function: Callable, *answers: RDD) -> RDD:
        """What function((block, rows, answers)) yields for all blocks."""

        def run(x) -> Iterator:
            yield from function(x)
            trim()

        return self.zipped(*answers).flatMap(run)

    def home(self, *answers: RDD) -> RDD:
        """(block, (k, payload)) for the payloads of each RDD k of answers, brought to the partitions of their blocks."""
        if answers not in self._home:
            tagged = [x.map(lambda y, k=k: (y[0], (k, y[1]))) for k, x in enumerate(answers)]
            together, parts = self.spark.sparkContext.union(tagged) if len(answers) > 1 else tagged[0], self.parts
            self._home[answers] = together.partitionBy(self.size, lambda block: block // parts if block >= 0 else -1 - block)
        return self._home[answers]

    def zipped(self, *answers: RDD) -> RDD:
        """(block, rows, lists): for each RDD of (block, payload) the list of the block's payloads. A payload for
        to_all(partition) comes to all blocks of the partition, but moves there once."""
        if not answers:
            return self.rdd.map(lambda x: (*x, ()))
        if answers not in self._zipped:
            n, parts, home = len(answers), self.parts, self.home(*answers)
            width = home.getNumPartitions()
            rows = self.rdd
            if width > self.size:  # more partitions than asked for: empty blocks for the others
                size = self.size
                more = self.spark.sparkContext.parallelize(range(size, width), width - size)
                rows = self.spark.sparkContext.union([rows, more.flatMap(lambda j: [(j * parts + k, []) for k in range(parts)])])

            def lists(it: Iterable) -> Iterator:
                out = [tuple([] for _ in range(n)) for _ in range(parts)]
                for block, (k, payload) in it:
                    for own in [out[block % parts]] if block >= 0 else out:
                        own[k].append(payload)
                yield from out
                del out
                trim()

            pairs = rows._reserialize(_ONE).zip(home.mapPartitions(lists)._reserialize(_ONE))
            self._zipped[answers] = pairs.map(lambda x: (*x[0], x[1]))
        return self._zipped[answers]


def to_all(partition: int) -> int:
    """The address of all blocks of a partition."""
    return -1 - partition


def _gather(part: int, rows: Iterable, step: int, parts: int) -> Iterator:
    """The partition's rows in `parts` pieces of about step bytes of text each."""
    piece, k, size = [], 0, 0
    for row in rows:
        piece.append(tuple(row))
        size += len(row[-1] or "") + 1
        if size >= step * (k + 1) and k < parts - 1:
            yield part * parts + k, piece
            piece, k = [], k + 1
    yield part * parts + k, piece
    for k in range(k + 1, parts):
        yield part * parts + k, []
    trim()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one payload; small integers shrink, codes (unsigned, of four bytes or more, or raw bytes) stay as they are."""
    out = []
    for a in arrays:
        raw = a.tobytes()
        small = zlib.compress(raw, 1) if a.dtype != np.uint64 and a.dtype != np.uint32 and a.dtype.kind != "V" else raw
        out.append((a.dtype.str, small is not raw, small))
    return pickle.dumps(out, 5)


def unpack(payload: bytes) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x) if packed else x, dtype) for dtype, packed, x in pickle.loads(payload)]


def bucket_of(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each code from its upper 32 bits; sorted codes have ascending buckets."""
    return ((codes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def cuts(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket starts among sorted codes (buckets + 1 values)."""
    return np.searchsorted(bucket_of(codes, buckets), np.arange(buckets + 1, dtype=np.uint64))


def short(codes: np.ndarray) -> np.ndarray:
    """32 bits of a code that its bucket does not tell: two codes of a bucket share them about once in 2**32."""
    return (codes & np.uint64(0xFFFFFFFF)).astype(np.uint32)


TAG_BITS = 40


def _base(bucket: int, buckets: int) -> np.uint64:
    """The least code of a bucket."""
    return np.uint64(-(-(bucket << 32) // buckets) << 32)


def narrow(codes: np.ndarray, bucket: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of a bucket in about four bytes each: their place in the bucket's range in 40 bits (two codes share one
    with a chance of a millionth), low 24 bits as they are, the rest as differences."""
    shift = np.uint64(max(0, 64 - (buckets.bit_length() - 1) - TAG_BITS))
    tags = (codes - _base(bucket, buckets)) >> shift
    low = np.ascontiguousarray((tags & np.uint64(0xFFFFFF)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3])
    steps = np.diff((tags >> np.uint64(24)).astype(np.int64), prepend=0)
    return fit(steps), low.view("V3").reshape(-1)


def entire(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes as they are, in the form of narrow()."""
    return codes, np.empty(0, "V3")


def widened(steps: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The 40-bit places of narrow(), or the codes of entire()."""
    if steps.dtype == np.uint64:
        return steps
    out = np.zeros((len(low), 4), np.uint8)
    out[:, :3] = low.view(np.uint8).reshape(-1, 3)
    return np.cumsum(steps.astype(np.int64)).astype(np.uint64) << np.uint64(24) | out.view("<u4").reshape(-1).astype(np.uint64)


def fit(counts: np.ndarray) -> np.ndarray:
    """Counts in the least type that holds them."""
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)


def repeats(blocks: Blocks, codes_of: Callable, most: int = 255) -> RDD:
    """For each block, how often its codes occur in the whole corpus, never too low.

    codes_of(rows) gives a block's codes, sorted and unique, and their counts. A code travels as its bucket and 32 bits
    (4 bytes instead of 8), so in about one of two thousand cases a count also holds another code's: use the counts to
    leave out what occurs once, not as a result. Counts above `most` are told as `most`. Decode with counts_of.
    """
    buckets = blocks.buckets()

    def request(block, rows, *got):
        codes, counts = codes_of(rows)
        at = cuts(codes, buckets)
        for b in range(buckets):
            if at[b] < at[b + 1]:
                part = slice(at[b], at[b + 1])
                yield b, pack(short(codes[part]), np.minimum(counts[part], most).astype(np.uint8))

    def answer(bucket, asked):
        if not asked:
            return
        parts = [(block, *unpack(payload)) for block, payload in asked]
        keys = np.concatenate([x[1] for x in parts])
        unique, where = np.unique(keys, return_inverse=True)
        total = np.minimum(np.bincount(where, np.concatenate([x[2] for x in parts])), most).astype(np.uint8)
        at = 0
        for block, own, _ in parts:
            yield block, (bucket, zlib.compress(total[where[at : at + len(own)]].tobytes(), 1))
            at += len(own)

    return blocks.ask(request, answer, buckets)


def counts_of(answers: list) -> np.ndarray:
    """The counts of a block's codes, in the order of the codes, from what repeats() answered."""
    parts = [np.frombuffer(zlib.decompress(x), np.uint8) for _, x in sorted(answers, key=lambda x: x[0])]
    return np.concatenate(parts) if parts else np.empty(0, np.uint8)

"""Messages between blocks of documents and buckets of codes, as rows of DataFrames.

A message is a row (to, block, payload): packed arrays for an address. dealt() brings the messages of an address together, in a
run of rows ordered by their sender, and an Arrow function reads a run at a time, so a task holds one address's
messages, not its whole partition. Everything is recomputed from lineage when an executor is lost: blocks are cut from input
splits, runs are sorted, and neither depends on the order in which a shuffle brings its rows.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import quoted

MESSAGE = "to long, block long, payload binary"
PARTITION = 64 << 20  # bytes of text whose codes meet in one partition, about
TAG = np.uint64((1 << 40) - 1)


def plain(df: DataFrame) -> DataFrame:
    """df so that a task that is run again gets its rows in the same order: rows of a shuffle are sorted."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df.sortWithinPartitions(*map(quoted, df.columns))
    return df


def text_bytes(df: DataFrame, column: str = "text") -> int:
    return df.agg(F.sum(F.coalesce(F.octet_length(column), F.lit(0)) + 1)).first()[0] or 0


def dealt(rows: DataFrame, size: int, hashed: bool = False) -> DataFrame:
    """The rows with those of an address in one run; size: bytes of the text behind them. hashed: addresses are not
    numbers from 0 on."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION))
    to = F.xxhash64("to") if hashed else F.col("to")
    return rows.repartitionById(n, F.pmod(to, F.lit(n)).cast("int")).sortWithinPartitions("to", "block")


def runs(batches: Iterator, column: int = 0) -> Iterator[tuple[int, list[tuple]]]:
    """(address, rows) for each run of equal addresses, each row as a tuple of its other columns; binary ones as buffers."""
    at, own = None, []
    for batch in batches:
        names = [i for i in range(batch.num_columns) if i != column]
        columns = []
        for i in names:
            x = batch.column(i)
            columns.append([None if not y.is_valid else y.as_buffer() for y in x] if "binary" in str(x.type) else x.to_pylist())
        to = batch.column(column).to_numpy()
        edges = np.concatenate(([0], np.flatnonzero(to[1:] != to[:-1]) + 1, [len(to)])).tolist() if len(to) else []
        for a, b in zip(edges[:-1], edges[1:]):
            if at is not None and int(to[a]) != at:
                yield at, own
                own = []
            at = int(to[a])
            own.extend(zip(*(x[a:b] for x in columns)))
    if own:
        yield at, own


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one payload; counts and places shrink, codes (unsigned, of 4 bytes or more, or raw bytes) stay as they are."""
    out = []
    for a in arrays:
        raw = a.tobytes()
        packed = a.dtype.kind != "V" and a.dtype not in (np.uint64, np.uint32) and len(raw) > 64
        out.append((a.dtype.str, packed, zlib.compress(raw, 1) if packed else raw))
    return pickle.dumps(out, 5)


def unpack(payload) -> list[np.ndarray]:
    return [np.frombuffer(zlib.decompress(x) if packed else x, dtype) for dtype, packed, x in pickle.loads(payload)]


def halves(tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """40-bit tags as five bytes each."""
    return tags.astype(np.uint32), (tags >> np.uint64(32)).astype(np.uint8).view("V1")


def whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.view(np.uint8).astype(np.uint64) << np.uint64(32)


def small(counts: np.ndarray) -> np.ndarray:
    """Counts in the least type that holds them."""
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)

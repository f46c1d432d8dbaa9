"""Token-ID files of directly addressable codes (DACs).

An id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk of every id, level k the chunk k of those ids
that have one; a continuation bitmap for each level but the last tells which ids go on, and a rank directory (bits set before each group of
512) finds an id's place on the next level. Any id is read with one probe a level, without decoding a block.

A shard image is self-contained: magic, counts, document directory (ids, null flags, offsets), then for each level its
chunks, bitmap and rank directory, little-endian. Images are rows of Parquet files in the shared folder, so that any
store that Spark writes to holds them, commits are atomic and a lost executor only repeats its own shards. They are not
compressed unless asked for, and each is a page of its own with its place in the file's page index: tokens_at() finds the shard by the
numbers of ids before it and reads that one page, of about SHARD_TOKENS ids, in which ids are addressed as above.

Documents are written in ascending doc_id order (null ids first, repeated ids next to each other by text); null and empty
texts hold the end id alone. Empty tables give no shard and no rows. Other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import scratch
from .words import slices, trim

MAGIC = b"DACIDS01"
GROUP = 512  # bits a rank entry covers
SHARD_TOKENS = 1 << 17
END_ID = 2
KNOWN = 500_000  # pieces whose ids an encoder remembers
BATCH_ROWS = 1000  # of an Arrow batch, which stays in memory on both sides
LINES = 200  # pieces that go to the library as one text
CHARS = 1 << 22  # bytes of texts encoded together, but for a longer one
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


class Level:
    """Chunks of one level, its continuation bitmap and rank directory."""

    def __init__(self, chunks: np.ndarray, bits: np.ndarray, ranks: np.ndarray):
        self.chunks, self.bits, self.ranks = chunks, bits, ranks

    @classmethod
    def of(cls, chunks: np.ndarray, more: np.ndarray) -> Level:
        if not more.any():  # the last level needs no bitmap
            return cls(chunks, np.empty(0, np.uint8), np.empty(0, np.uint64))
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate((bits, np.zeros(-len(bits) % (GROUP // 8), np.uint8)))
        full = _POP[bits].reshape(-1, GROUP // 8).sum(axis=1, dtype=np.uint64)
        return cls(chunks, bits, np.concatenate((np.zeros(1, np.uint64), np.cumsum(full, dtype=np.uint64))))

    def goes_on(self, i: int) -> bool:
        return len(self.bits) > 0 and bool(self.bits[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """Bits set before place i."""
        group = i // GROUP
        first, whole = group * GROUP // 8, i >> 3
        before = int(self.ranks[group]) + int(_POP[self.bits[first:whole]].sum())
        return before + (int(_POP[self.bits[whole] & ((1 << (i & 7)) - 1)]) if i & 7 else 0)


class Shard:
    """One image: random access to its ids and documents."""

    def __init__(self, doc_ids: np.ndarray, nulls: np.ndarray, offsets: np.ndarray, levels: list[Level]):
        self.doc_ids, self.nulls, self.offsets, self.levels = doc_ids, nulls, offsets, levels

    @classmethod
    def encode(cls, doc_ids: Sequence[int | None], ids: np.ndarray, offsets: np.ndarray) -> Shard:
        levels, rest = [], ids.astype(np.uint32)
        while True:
            more = rest > 0xFF
            levels.append(Level.of((rest & np.uint32(0xFF)).astype(np.uint8), more))
            if not more.any():
                break
            rest = rest[more] >> np.uint32(8)
        return cls(np.array([x or 0 for x in doc_ids], np.int64), np.array([x is None for x in doc_ids], np.uint8), offsets.astype(np.uint64), levels)

    def __len__(self) -> int:
        return len(self.levels[0].chunks)

    def __getitem__(self, i: int) -> int:
        """The id at place i: one probe a level."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, level in enumerate(self.levels):
            value |= int(level.chunks[i]) << 8 * k
            if not level.goes_on(i):
                break
            i = level.rank(i)
        return value

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The ids of places start to stop, read from those places alone."""
        out, at = np.zeros(stop - start, np.uint32), np.arange(stop - start)
        for k, level in enumerate(self.levels):
            if not len(at):
                break
            out[at] |= level.chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            if not len(level.bits):
                break
            first = start >> 3
            more = np.unpackbits(level.bits[first : (stop + 7) >> 3], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            at, start = at[more], level.rank(start)
            stop = start + len(at)
        return out

    def to_bytes(self) -> bytes:
        head = struct.pack("<8sIQQ", MAGIC, len(self.levels), len(self.doc_ids), len(self))
        parts = [head, struct.pack(f"<{len(self.levels)}Q", *(len(x.chunks) for x in self.levels)), self.doc_ids.astype("<i8").tobytes(), self.nulls.tobytes(), self.offsets.astype("<u8").tobytes()]
        for x in self.levels:
            parts += [x.chunks.tobytes(), x.bits.tobytes(), x.ranks.astype("<u8").tobytes()]
        return b"".join(parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Shard:
        magic, n_levels, n_docs, _ = struct.unpack_from("<8sIQQ", raw)
        if magic != MAGIC:
            raise ValueError("not a token-ID shard")
        at = struct.calcsize("<8sIQQ")
        sizes = struct.unpack_from(f"<{n_levels}Q", raw, at)
        at += 8 * n_levels

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, n, at)
            at += out.nbytes
            return out

        ids, nulls, offsets = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs + 1)
        levels = []
        for k, n in enumerate(sizes):
            if k == n_levels - 1:
                levels.append(Level(take("u1", n), take("u1", 0), take("<u8", 0)))
                break
            groups = -(-n // GROUP)
            levels.append(Level(take("u1", n), take("u1", groups * GROUP // 8), take("<u8", groups + 1)))
        return cls(ids, nulls, offsets, levels)


class Encoder:
    """Ids of texts from a tokenizer file, as the library's encode gives them.

    Byte-level pre-tokenizers of the usual pattern never join what stands on both sides of a single space between two
    other characters, so a text is cut there, and the library encodes each different piece once. Texts with other white
    space next to a space, or with a special token's string, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        pre = self.tokenizer.pre_tokenizer
        self.cuts = self.tokenizer.normalizer is None and "ByteLevel(" in str(pre) and "add_prefix_space=False" in str(pre) and "use_regex=True" in str(pre)
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids if self.cuts else []
        self.cuts = self.cuts and len(self.line) == 1
        self.known: dict[str, tuple[pa.Array, np.ndarray, np.ndarray]] = {}

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, pieces: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of known pieces in a row, how many each has, and where the given ones are among them."""
        known, ids, lengths = self.known.setdefault(before, (pa.array([], pieces.type), np.empty(0, np.uint32), np.empty(0, np.int64)))
        found = pc.index_in(pieces, value_set=known)
        new = pieces.filter(pc.is_null(found))
        more, n = self._new_pieces(new, before)
        ids, lengths = np.concatenate((ids, more)), np.concatenate((lengths, n))
        known = pa.concat_arrays([known, new])
        if len(known) <= KNOWN:
            self.known[before] = known, ids, lengths
        at = found.to_numpy(zero_copy_only=False)
        at = np.where(np.isnan(at), 0, at).astype(np.int64) if at.dtype.kind == "f" else at.astype(np.int64)
        missing = found.is_null().to_numpy(zero_copy_only=False)
        at[missing] = len(known) - len(new) + np.arange(len(new))
        return ids, lengths, at

    def _new_pieces(self, pieces: pa.Array, before: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, each with `before` in front, and how many each has: -1 where a piece must not
        stand alone. They go to the library as lines of longer texts; a line feed between two other characters is a
        token of its own, and where counts show otherwise the pieces go one by one."""
        texts, feeds = pieces.to_pylist(), pc.count_substring(pieces, "\n").to_numpy(zero_copy_only=False)
        alone = pc.and_(pc.greater(pc.utf8_length(pieces), 0), pc.equal(pc.utf8_trim_whitespace(pieces), pieces))
        good = np.flatnonzero(alone.to_numpy(zero_copy_only=False))
        lengths, out = np.full(len(texts), -1, np.int64), [np.empty(0, np.uint32)]
        for k in range(0, len(good), LINES):
            own = good[k : k + LINES]
            ids = self._whole([before + ("\n" + before).join([texts[i] for i in own])])[0]
            at = np.flatnonzero(ids == self.line[0])
            ends = np.cumsum(feeds[own] + 1)
            if len(at) == ends[-1] - 1:
                at = np.concatenate(([-1], at[ends[:-1] - 1], [len(ids)]))
                lengths[own] = np.diff(at) - 1
                out.append(np.delete(ids, at[1:-1]))
            else:
                each = self._whole([before + texts[i] for i in own])
                lengths[own] = [len(x) for x in each]
                out += each
        return np.concatenate(out), lengths

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with end_id behind, and how many each has. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        whole = np.full(len(texts), not self.cuts)
        for x in self.special:
            whole |= pc.match_substring(texts, x).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, tails = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        offsets -= offsets[0]
        heads, own = np.unique(codes[offsets[:-1]], return_inverse=True)
        codes[offsets[:-1]] = len(tails) + own
        (ids, n, at), (head_ids, head_n, head_at) = self._pieces(tails, " "), self._pieces(tails.take(pa.array(heads)), "")
        ids, lengths, at = [ids, head_ids], np.concatenate((n, head_n)), np.concatenate((at, head_at + len(n)))
        codes = at[codes]
        whole |= np.minimum.reduceat(lengths[codes], offsets[:-1]) < 0 if len(texts) else whole
        whole &= ~empty
        which = np.flatnonzero(whole)
        each = self._whole(texts.take(pa.array(which)).to_pylist())
        ids = np.concatenate([*ids, *each, np.array([end_id], np.uint32)])
        lengths = np.concatenate((np.maximum(lengths, 0), [len(x) for x in each], [1])).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        of_whole = dict(zip(which.tolist(), range(len(lengths) - 1 - len(each), len(lengths) - 1)))
        last, out, sizes, part, held = len(lengths) - 1, [], [], [], 0
        for i in range(len(texts)):
            own = [] if empty[i] else [of_whole[i]] if i in of_whole else codes[offsets[i] : offsets[i + 1]]
            part += [own, [last]]
            sizes.append(int(lengths[own].sum()) + 1 if len(own) else 1)
            held += len(own)
            if held > 1 << 17 or i == len(texts) - 1:
                own = np.concatenate(part).astype(np.int64)
                n = lengths[own]
                ends = np.cumsum(n)
                out.append(ids[np.arange(ends[-1]) + np.repeat(starts[own] - ends + n, n)])
                part, held = [], 0
        return np.concatenate([np.empty(0, np.uint32), *out]), np.array(sizes, np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ends_of_shards(sizes: np.ndarray, have: int, most: int) -> Iterator[int]:
    """Where documents of these sizes bring shards to `most` ids, the first of which has some already; then the end."""
    for i, n in enumerate(sizes.tolist()):
        have += n
        if have >= most:
            have = 0
            yield i + 1
            if i + 1 == len(sizes):
                return
    yield len(sizes)


IMAGES = "part int, shard int, before long, n_ids long, image binary"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, n): equal rows next to each other as one."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        new = np.ones(len(ids), bool)
        for x in (ids, texts):
            same = pc.equal(x[1:], x[:-1]).fill_null(False).to_numpy(zero_copy_only=False) if len(x) > 1 else np.empty(0, bool)
            gone = x.is_null().to_numpy(zero_copy_only=False)
            own = same | (gone[1:] & gone[:-1])
            new[1:] = ~own if x is ids else new[1:] | ~own
        first = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(first)), texts.take(pa.array(first)), pa.array(np.diff(np.append(first, len(ids))), pa.int32())], ["doc_id", "text", "n"])
        trim()


def _repeated(ids: np.ndarray, sizes: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids and sizes of documents that each stand `times` times, and which document each is."""
    which = np.repeat(np.arange(len(sizes)), times)
    if len(which) == len(sizes):
        return ids, sizes, which
    n = sizes[which]
    ends = np.cumsum(n)
    starts = np.cumsum(sizes) - sizes
    return ids[np.arange(ends[-1]) + np.repeat(starts[which] - ends + n, n)], n, which


def write_token_files(docs: DataFrame, tokenizer_path: str, *, out: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, runs: bool = False, compression: str = "none") -> str:
    """Writes docs(doc_id, text) as shard images in ascending doc_id order; returns the folder.

    tokenizer_path must name the same file on all machines. A shard ends after the document that brings it to
    shard_tokens ids. Texts are shuffled once, by ranges of doc_id; with `runs`, equal rows next to each other
    (a mixture repeats documents so) travel and are encoded once. compression: of pages, by Parquet's names; an id then costs the
    decompression of its page.
    """
    out = out or scratch(docs.sparkSession, "tokens")
    # the beginnings of texts split ranges of ids that many rows have, null ones among them
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.mapInArrow(_runs, "doc_id long, text string, n int") if runs else rows
    ordered = rows.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, shard, before, enc = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer_path)
        doc_ids: list[pa.Array] = []
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []

        def image() -> pa.RecordBatch:
            names = [x for some in doc_ids for x in some.to_pylist()]
            made = Shard.encode(names, np.concatenate(ids), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([len(made)], pa.int64()), pa.array([made.to_bytes()], pa.binary())], ["part", "shard", "before", "n_ids", "image"])

        for batch in batches:
            for a, b in slices(batch.column(1), CHARS):
                own, n = enc.encode(batch.column(1).slice(a, b - a), end_id)
                names, at = batch.column(0).slice(a, b - a), 0
                if runs:
                    own, n, which = _repeated(own, n, batch.column(2).slice(a, b - a).to_numpy())
                    names = names.take(pa.array(which))
                for cut in ends_of_shards(n, sum(map(len, ids)), shard_tokens):
                    doc_ids.append(names.slice(at, cut - at))
                    ids.append(own[: (done := int(n[at:cut].sum()))])
                    sizes.append(n[at:cut])
                    own, at = own[done:], cut
                    if sum(map(len, ids)) >= shard_tokens:
                        yield (made := image())
                        shard, before = shard + 1, before + made.column(3)[0].as_py()
                        doc_ids, ids, sizes = [], [], []
                del own, n
            del batch
        if sizes and sum(map(len, sizes)):
            yield image()
        del doc_ids, ids, sizes
        trim()

    conf, key = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = conf.get(key)
    try:
        conf.set(key, str(min(int(old), BATCH_ROWS) if int(old) > 0 else BATCH_ROWS))
        one_a_page = {"compression": compression, "parquet.page.row.count.limit": "1", "parquet.enable.dictionary": "false"}
        ordered.mapInArrow(images, IMAGES).write.options(**one_a_page).parquet(out)
    finally:
        conf.set(key, old)
    return out


def _shards(spark, folder: str) -> tuple[DataFrame, dict[int, int]]:
    """The images, and the ids before each written partition; the driver gathers one total for each of those."""
    shards = spark.read.schema(IMAGES).parquet(folder)
    start, starts = 0, {}
    for part, n in sorted(map(tuple, shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())):
        starts[part] = start
        start += n
    return shards, starts


def tokens_at(spark, folder: str, start: int, stop: int | None = None) -> np.ndarray:
    """The ids of places start to stop (one by default) of the whole stream, which must lie within one shard or go on into
    the next ones: only pages of shards that hold them are read."""
    stop = start + 1 if stop is None else stop
    shards, starts = _shards(spark, folder)
    out, at = [], start
    while at < stop:
        part = max((p for p, before in starts.items() if before <= at), key=lambda p: (starts[p], p), default=None)
        found = None if part is None else shards.where((F.col("part") == part) & (F.col("before") <= at - starts[part])).agg(F.max(F.struct("before", "shard", "n_ids")).alias("x")).first().x
        if found is None or at - starts[part] >= found.before + found.n_ids:
            raise IndexError(at)
        image = shards.where((F.col("part") == part) & (F.col("shard") == found.shard)).select("image").first().image
        first = at - starts[part] - found.before
        last = min(stop - starts[part] - found.before, found.n_ids)
        out.append(Shard.from_bytes(bytes(image)).slice(first, last))
        at += last - first
    return np.concatenate([np.empty(0, np.uint32), *out])


def read_token_files(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): each document's place in the whole stream, and its ids, from the images."""
    shards, starts = _shards(spark, folder)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, image in zip(*(batch.column(k).to_pylist() for k in range(3))):
                shard = Shard.from_bytes(image)
                at = shard.offsets.astype(np.int64)
                for k in range(0, len(shard.doc_ids), 500):
                    ends = at[k : k + 501]
                    ids = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(shard.slice(int(ends[0]), int(ends[-1])).astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[k : k + 500], mask=shard.nulls[k : k + 500].astype(bool)), pa.array(ends[:-1] + (starts[part] + before)), pa.array(np.diff(ends)), ids], ["doc_id", "start", "n_tokens", "ids"])

    return shards.select("part", "before", "image").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids array<long>")


def digest_token_files(spark, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) as read_token_files, with the CRC-32 of the ids as unsigned 32-bit
    little-endian integers instead of the ids."""
    shards, starts = _shards(spark, folder)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, image in zip(*(batch.column(k).to_pylist() for k in range(3))):
                shard = Shard.from_bytes(image)
                at = shard.offsets.astype(np.int64)
                raw = memoryview(shard.slice(0, len(shard)).astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, mask=shard.nulls.astype(bool)), pa.array(at[:-1] + (starts[part] + before)), pa.array(np.diff(at)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
                del shard, raw
                trim()

    return shards.select("part", "before", "image").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")

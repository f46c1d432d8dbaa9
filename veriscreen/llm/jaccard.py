"""Exact Jaccard join of documents on word shingles, with adaptive multi-match prefixes.

A document's set holds its distinct shingles of `width` words, lower-cased in A-Z; with fewer words the whole sequence is its
only shingle, without words the set is empty and links with nothing. Two documents link when
den * |intersection| >= num * |union|. Equal sets form one class; a class links as one document.

1. Counts. Texts are read once. Blocks of documents send the shingles of their classes to buckets; a shingle that many
   classes of a block hold goes once, with its number. Buckets tell each block which of them other classes hold too, and
   about how many (a logarithmic byte): the join orders shingles from the rarest. What is held once never travels again,
   and cannot be in any intersection.
2. Prefixes. Any two sets that link share l or more of their first |x| - ceil(t|x|) + l shingles (t = num / den), for
   every l. Each document takes the l for which the estimated cost of its candidates, from the counts, is least: a longer
   prefix reads more postings, but asks for more shared shingles before verification. Documents without a repeated
   shingle in their prefix, the great majority, send nothing.
3. Families. Classes whose prefixes share a shingle, and whose sizes let them link (directly, or by sizes between), are of
   one family. A block joins its own classes first and sends one interval of sizes a shingle, so that a shingle of a third
   of all documents reaches its bucket once a block.
4. Tiles. Families, with the repeated shingles of their classes, meet in tiles of about TILE shingles: many small
   families in one, a large one cut into size bands and parts of them, of which only those that can link meet. In a tile each
   class counts the prefix shingles that it shares with those before it; pairs with min(l, l') or more, and with sizes that
   fit, are verified on the shared ones of all their repeated shingles. Each pair of a family meets in exactly one tile.
   No pair becomes a row: a tile gives the number of links of each class, and a class of its own that it is connected to.

Verification is exact, on 40 bits and the bucket of a shingle's 64-bit code: two different shingles fall together with a chance of
about 1e-12 divided by the number of buckets. Work in tiles grows with the square of a family's size, with a few machine words
a pair. Null and repeated ids are kept as rows; a null id never names a component of others. Empty tables give no rows.
Other columns are ignored by join(), and pass through keep_first(), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .exchange import bucket_of
from .post import MESSAGE, TAG, dealt, halves, pack, plain, runs, small, text_bytes, unpack, whole
from .shared import components, forget, written
from .words import block_sets, set_keys, slices, trim

WIDTH = 5
JACCARD = (3, 4)
MAX_MATCHES = 4
VERIFY_COST = 16  # of a candidate, in postings read
BLOCK = 16 << 20  # bytes of text and of shingle codes of a block, about
SHARE = 8 << 20  # bytes of text whose shingles go to one bucket, so that its part stays the same as the corpus grows
HOT = 64  # classes of a block that make a shingle go once for all
PART = 1024  # shingles in a row of a set
TILE = 1 << 19  # shingles of a tile, about
STEPS = 8  # levels of a count between powers of two

POSTED = f"kind int, {MESSAGE}, key long, part int, n int, matches int, used int, tokens binary, other long, docs array<struct<doc_id:long,row:long,n:int,key:long>>"
POSTINGS, SETS, LOCAL, DOCS = range(4)


def prefixes(n: np.ndarray, first: np.ndarray, reads: np.ndarray, start: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Length and matches l of the cheapest prefix of each set. n: sizes; first: how many shingles stand before the ones that
    cost anything; reads: prefix sums of costs, those of a set from `start` on."""
    least = -(-num * n // den)  # shingles that a linked set shares at least
    best = cost = None
    for k in range(1, MAX_MATCHES + 1):
        paid = np.maximum(n - least + k - first, 0)
        own = np.where(k <= np.maximum(least, 1), (reads[np.minimum(start + paid, len(reads) - 1)] - reads[start]) * (1 + VERIFY_COST / k), np.inf)
        best, cost = (np.ones(len(n), np.int64), own) if best is None else (np.where(own < cost, k, best), np.minimum(own, cost))
    return n - least + best, best


def prefix(freq: np.ndarray, num: int, den: int) -> tuple[int, int]:
    """prefixes() of one set whose counts, in the join's order, are freq."""
    one = np.zeros(1, np.int64)
    size, matches = prefixes(one + len(freq), one, np.concatenate(([0.0], np.cumsum(freq - 1.0))), one, num, den)
    return int(size[0]), int(matches[0])


def level(count: np.ndarray) -> np.ndarray:
    """Counts as one byte each: STEPS levels between powers of two."""
    return np.minimum(np.floor(STEPS * np.log2(count) + 1e-9), 255).astype(np.uint8)


def _rows(kind: int, many: int, /, **columns) -> pa.RecordBatch:
    """Rows of POSTED; columns that are not given are null."""
    out = [pa.array(np.full(many, kind), pa.int32())]
    for field in list(_SCHEMA)[1:]:
        given = columns.get(field.name)
        out.append(pa.nulls(many, field.type) if given is None else given if isinstance(given, pa.Array) else pa.array(given, field.type))
    return pa.RecordBatch.from_arrays(out, schema=_SCHEMA)


_DOC = pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("n", pa.int32()), ("key", pa.int64())])
_SCHEMA = pa.schema([("kind", pa.int32()), ("to", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("key", pa.int64()), ("part", pa.int32()), ("n", pa.int32()), ("matches", pa.int32()), ("used", pa.int32()), ("tokens", pa.binary()), ("other", pa.int64()), ("docs", pa.list_(_DOC))])
_MESSAGE = pa.schema([("to", pa.int64()), ("block", pa.int64()), ("payload", pa.binary())])


def _messages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _MESSAGE)], schema=_MESSAGE)


def _reader(width: int, buckets: int):
    """Blocks of (doc_id, row, text): the shingles of their classes to buckets; what stays at home, to the bucket -1 - k."""

    def block(at: int, codes: np.ndarray, sizes: np.ndarray, ids: pa.Array, rows: pa.Array) -> Iterator[pa.RecordBatch]:
        keys = set_keys(codes, sizes)
        full = np.flatnonzero(sizes)
        own, first, cls = np.unique(keys[full], return_index=True, return_inverse=True)
        # classes are numbered by their first texts, which stand for them
        order = np.argsort(first)
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        own, of = own[order], np.full(len(sizes), -1, np.int32)
        of[full] = rank[cls]
        lead = np.zeros(len(sizes), bool)
        lead[full[first]] = True
        codes, n = codes[np.repeat(lead, sizes)], sizes[lead]
        owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
        # shingles of many classes go once
        cell = (codes >> np.uint64(44)).astype(np.int32)
        many = (np.bincount(cell, minlength=1 << 20) >= HOT)[cell]
        del cell
        hot, where, count = np.unique(codes[many], return_inverse=True, return_counts=True)
        keep = count >= HOT
        many[many] = keep[where]
        holders = owner[many][np.argsort(codes[many], kind="stable")]
        hot, count = hot[keep], count[keep]
        codes, owner = codes[~many], owner[~many]
        to = np.empty(len(codes), np.uint16 if buckets <= 1 << 16 else np.int64)
        for k in range(0, len(codes), 1 << 18):
            to[k : k + (1 << 18)] = bucket_of(codes[k : k + (1 << 18)], buckets)
        by = np.argsort(to, kind="stable")
        cuts = np.concatenate(([0], np.cumsum(np.bincount(to, minlength=buckets))))
        del to
        codes, owner = codes[by], owner[by]
        del by
        hot_cuts = np.searchsorted(bucket_of(hot, buckets), np.arange(buckets + 1))
        home = pack(n.astype(np.int32), own, small(count), holders, hot, of, sizes.astype(np.int32), np.array([x is not None for x in ids.to_pylist()]), ids.fill_null(0).to_numpy(), rows.to_numpy())
        out = [(-1 - at % buckets, at, home)]
        for b in range(buckets):
            a, z, c, d = cuts[b], cuts[b + 1], hot_cuts[b], hot_cuts[b + 1]
            if a < z or c < d:
                held = np.bincount(owner[a:z], minlength=len(n))
                out.append((b, at, pack(small(held), *halves(codes[a:z] & TAG), *halves(hot[c:d] & TAG), small(count[c:d]))))
            if len(out) >= 256 or b == buckets - 1:
                yield _messages(out) if out else _messages([(-1, at, None)]).slice(0, 0)
                out = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, k, size
            codes, sizes, ids, rows = (list(x) for x in zip(*held))
            held, size = [], 0
            whole_block = [np.concatenate(codes)]
            codes.clear()
            yield from block(part << 24 | k, whole_block.pop(), np.concatenate(sizes), pa.concat_arrays(ids), pa.concat_arrays(rows))
            k += 1
            trim()

        for batch in batches:
            texts = batch.column(2)
            for a, b in slices(texts):
                own = texts.slice(a, b - a)
                held.append((*block_sets(own, width), batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)))
                size += 8 * len(held[-1][0]) + b - a
                if size >= BLOCK:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets: to each block its shingles that several classes hold, and the level of their number."""
    for bucket, rows in runs(batches):
        if bucket < 0:
            yield from (_messages([(block, -1, payload.to_pybytes())]) for block, payload in rows)
            continue
        parts = [(block, *unpack(payload)) for block, payload in rows]
        singles = [whole(x[2], x[3]) for x in parts]
        hots = [whole(x[4], x[5]) for x in parts]
        tags = np.concatenate([*singles, *hots])
        times = np.concatenate([*(np.ones(len(x), np.int64) for x in singles), *(x[6].astype(np.int64) for x in parts)])
        by = np.argsort(tags)
        new = np.flatnonzero(np.concatenate(([True], tags[by][1:] != tags[by][:-1])))
        total = np.add.reduceat(times[by], new)
        told = np.empty(len(tags), np.uint8)
        told[by] = np.repeat(level(total), np.diff(np.append(new, len(tags))))
        at, hot_at, out = 0, sum(map(len, singles)), []
        for (block, held, *_), own, hot in zip(parts, singles, hots):
            own_told, hot_told = told[at : at + len(own)], told[hot_at : hot_at + len(hot)]
            at, hot_at = at + len(own), hot_at + len(hot)
            again = np.flatnonzero(own_told)
            if len(again) or len(hot):
                which = np.repeat(np.arange(len(held)), held)[again]
                out.append((block, bucket, pack(small(np.bincount(which, minlength=len(held))), *halves(own[again]), own_told[again], hot_told)))
        if out:
            yield _messages(out)
        trim()


def _poster(buckets: int, num: int, den: int):
    """Blocks: prefixes of the classes that may link, as postings; their repeated shingles; links of a block's own
    classes to families; the documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in runs(batches):
            n, own, count, holders, hot, of, sizes, valid, ids, row = unpack(rows[0][1])
            docs = pa.StructArray.from_arrays([pa.array(ids, mask=~valid), pa.array(row), pa.array(sizes), pa.array(own.view(np.int64)[of] if len(own) else np.zeros(len(of), np.int64), mask=of < 0)], fields=list(_DOC))
            yield _rows(DOCS, 1, docs=pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs))
            parts = [(bucket, *unpack(payload)) for bucket, payload in rows[1:]]
            classes = np.arange(len(n))
            owner = np.concatenate([np.empty(0, np.int64), *(np.repeat(classes[: len(x[1])], x[1]) for x in parts), holders])
            hot_tokens = bucket_of(hot, buckets) << np.uint64(40) | hot & TAG
            token = np.concatenate([np.empty(0, np.uint64), *(np.uint64(x[0]) << np.uint64(40) | whole(x[2], x[3]) for x in parts), np.repeat(hot_tokens, count)])
            height = np.concatenate([np.empty(0, np.uint8), *(x[4] for x in parts), np.repeat(np.concatenate([np.empty(0, np.uint8), *(x[5] for x in parts)]), count)])
            del parts
            repeated = np.bincount(owner, minlength=len(n))
            sizes = n.astype(np.int64)
            alone = sizes - repeated
            shares = (repeated > 0) & (alone < sizes - -(-num * sizes // den) + 1)  # with a repeated shingle in the shortest prefix
            if not shares.any():
                continue
            mine = shares[owner]
            owner, token, height = owner[mine], token[mine], height[mine]
            by = np.lexsort((token, height, owner))  # rarest first, then by code
            owner, token, height = owner[by], token[by], height[by]
            used = np.flatnonzero(shares)
            held = repeated[used]
            starts = np.cumsum(held) - held
            reads = np.concatenate(([0.0], np.cumsum(np.exp2(height / STEPS) - 1)))
            length, matches = prefixes(sizes[used], alone[used], reads, starts, num, den)
            length = np.minimum(length - alone[used], held)
            yield from _sets(own.view(np.int64)[used], sizes[used], matches, length, token, starts, held)
            place = np.arange(len(owner)) - np.repeat(starts, held)
            front = place < np.repeat(length, held)
            yield from _joined(block, own[used], sizes[used], np.repeat(np.arange(len(used)), held)[front], token[front], num, den)
            trim()

    return run


def _sets(key, n, matches, used, token, starts, held) -> Iterator[pa.RecordBatch]:
    parts = -(-held // PART)
    which = np.repeat(np.arange(len(held)), parts)
    part = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
    a = starts[which] + part * PART
    z = np.minimum(a + PART, (starts + held)[which])
    raw = token.tobytes()
    for k in range(0, len(which), 2048):
        own = slice(k, k + 2048)
        yield _rows(SETS, len(which[own]), key=key[which[own]], part=part[own].astype(np.int32), n=n[which[own]].astype(np.int32), matches=matches[which[own]].astype(np.int32), used=used[which[own]].astype(np.int32), tokens=pa.array([raw[8 * x : 8 * y] for x, y in zip(a[own].tolist(), z[own].tolist())], pa.binary()))


def _spans(token: np.ndarray, low: np.ndarray, high: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of intervals of sizes by token and low, and where a new span begins in it: at another token, or where no
    size so far can link with the next."""
    by = np.lexsort((low, token))
    t, a = token[by], low[by]
    first = np.concatenate(([True], t[1:] != t[:-1])) if len(t) else np.empty(0, bool)
    # running maximum of high within a token: tokens are raised by more than any size
    lift = np.cumsum(first).astype(np.int64) << 40
    top = np.maximum.accumulate(high[by].astype(np.int64) + lift) - lift
    if len(t):
        first[1:] |= top[:-1] * den < a[1:].astype(np.int64) * num
    return by, first


def _joined(block: int, key, n, owner, token, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Postings of a block: of each shingle and span of sizes one class with the span's ends; links to it for the others."""
    by, first = _spans(token, n[owner], n[owner], num, den)
    head = np.flatnonzero(first)
    group = np.cumsum(first) - 1
    last = np.append(head[1:], len(by)) - 1
    # the class with the least key of a span stands for it
    keys = key[owner[by]]
    least = np.minimum.reduceat(keys, head)
    edges = np.unique(np.column_stack((keys, least[group]))[keys != least[group]], axis=0).view(np.int64)
    for k in range(0, len(edges), 1 << 16):
        own = edges[k : k + (1 << 16)]
        yield _rows(LOCAL, len(own), key=np.ascontiguousarray(own[:, 0]), other=np.ascontiguousarray(own[:, 1]))
    low, high, tokens = n[owner[by[head]]], n[owner[by[last]]], token[by[head]]
    to = (tokens >> np.uint64(40)).astype(np.int64)
    cuts = np.concatenate((np.flatnonzero(np.diff(to, prepend=-1)), [len(to)])).tolist()
    out = []
    for a, z in zip(cuts[:-1], cuts[1:]):
        out.append((int(to[a]), block, pack(*halves(tokens[a:z] & TAG), small(low[a:z]), small(high[a:z]), least[a:z])))
    for k in range(0, len(out), 1024):
        rows = _messages(out[k : k + 1024])
        yield _rows(POSTINGS, rows.num_rows, to=rows.column(0), block=rows.column(1), payload=rows.column(2))


def _finder(num: int, den: int):
    """Buckets: links (a, b) between the classes that stand for spans of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches):
            parts = [unpack(payload) for _, payload in rows]
            tags = np.concatenate([whole(x[0], x[1]) for x in parts])
            low, high = (np.concatenate([x[k].astype(np.int64) for x in parts]) for k in (2, 3))
            key = np.concatenate([x[4] for x in parts])
            by, first = _spans(tags, low, high, num, den)
            least = np.minimum.reduceat(key[by], np.flatnonzero(first))[np.cumsum(first) - 1]
            pairs = np.column_stack((key[by], least))[key[by] != least]
            pairs = np.unique(pairs, axis=0).view(np.int64)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], ["a", "b"])
            trim()

    return run


class Incidence:
    """Which of n owners hold which codes: bits for codes of many owners, posting lists for others of two or more."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray, n: int):
        unique, at, count = np.unique(codes, return_inverse=True, return_counts=True)
        dense = count >= max(16, n // 64)
        column = np.cumsum(dense) - 1
        wide = int(dense.sum())
        self.bits = np.zeros((n, -(-wide // 64)), np.uint64)
        own = dense[at]
        by = np.argsort(owner[own], kind="stable")
        who, col = owner[own][by], column[at[own]][by]
        for a in range(0, n, 256):  # bytes become bits for some owners at a time
            x, y = np.searchsorted(who, (a, a + 256))
            if x < y:
                flat = np.zeros((min(256, n - a), 64 * self.bits.shape[1]), bool)
                flat[who[x:y] - a, col[x:y]] = True
                self.bits[a : a + 256] = np.packbits(flat, axis=1).view(np.uint64)
        rare = ~dense[at] & (count[at] > 1)
        by = np.argsort(at[rare], kind="stable")
        self.lists = owner[rare][by]  # of each rare code, its owners
        code = at[rare][by]
        start = np.searchsorted(code, code, "left")
        stop = np.searchsorted(code, code, "right")
        back = np.argsort(self.lists, kind="stable")  # the codes of each owner, as ranges of lists
        self.start, self.size = start[back], (stop - start)[back]
        self.first = np.searchsorted(self.lists[back], np.arange(n + 1))
        self.n = n

    def shared(self, i: int, upto: int) -> np.ndarray:
        """How many of owner i's codes each owner before `upto` holds."""
        out = np.bitwise_count(self.bits[:upto] & self.bits[i]).sum(axis=1, dtype=np.int64) if self.bits.shape[1] else np.zeros(upto, np.int64)
        start, size = self.start[self.first[i] : self.first[i + 1]], self.size[self.first[i] : self.first[i + 1]]
        if len(size):
            at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            out += np.bincount(self.lists[at], minlength=self.n)[:upto]
        return out


def linked(sets: list[np.ndarray], n: np.ndarray, matches: np.ndarray, used: np.ndarray, num: int, den: int, ahead: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(i, those before i that link with it), of repeated shingles in the join's order; with `ahead`, i runs from there on and
    only the first `ahead` ones are looked at."""
    total = len(sets)
    size = [min(int(u), len(x)) for x, u in zip(sets, used)]
    front = Incidence(np.concatenate([x[:k] for x, k in zip(sets, size)]), np.repeat(np.arange(total), size), total)
    entire: Incidence | None = None
    ordered: dict[int, np.ndarray] = {}

    def codes(i: int) -> np.ndarray:
        if i not in ordered:
            ordered[i] = np.sort(sets[i])
        return ordered[i]

    for i in range(ahead or 1, total):
        upto = ahead or i
        both = front.shared(i, upto)
        near = np.flatnonzero((both >= np.minimum(matches[:upto], matches[i])) & (np.minimum(n[:upto], n[i]) * den >= np.maximum(n[:upto], n[i]) * num))
        if not len(near):
            continue
        if len(near) <= 6:
            x, both = codes(i), np.empty(len(near), np.int64)
            for k, j in enumerate(near.tolist()):
                y = codes(j)
                both[k] = (y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()
        else:
            if entire is None:
                entire = Incidence(np.concatenate(sets), np.repeat(np.arange(total), [len(x) for x in sets]), total)
            both = entire.shared(i, upto)[near]
        found = near[both * den >= num * (n[near] + n[i] - both)]
        if len(found):
            yield i, found


def _tiler(num: int, den: int):
    """Tiles: (key, whole, other, n_links) of the classes that link: other is the least class connected to it in the tile."""

    def solve(members: list[tuple], ahead: int, alone: bool) -> Iterator[pa.RecordBatch]:
        key, weight, n, matches, used, sets = zip(*members)
        key, weight, n, matches = (np.array(x, np.int64) for x in (key, weight, n, matches))
        links, label = np.zeros(len(key), np.int64), np.arange(len(key))
        for i, found in linked(list(sets), n, matches, np.array(used), num, den, ahead):
            links[i] += weight[found].sum()
            links[found] += weight[i]
            labels = np.unique(label[found])
            labels = labels if label[i] in labels else np.append(labels, label[i])
            if len(labels) > 1:
                label[np.isin(label, labels)] = labels.min()
        own = np.flatnonzero(links)
        if len(own):
            low = np.full(len(key), np.iinfo(np.int64).max)
            np.minimum.at(low, label, key)
            yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(np.full(len(own), alone)), pa.array(low[label[own]]), pa.array(links[own])], ["key", "whole", "other", "n_links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0  # whole families, solved together: no prefix shingle is in two that could link
        for _, rows in runs(batches):
            members, last = [], None
            for side, key, part, weight, n, matches, used, tokens in rows:
                if (side, key) == last:
                    parts[part] = np.frombuffer(tokens, np.uint64)
                    continue
                last, parts = (side, key), {part: np.frombuffer(tokens, np.uint64)}
                members.append((side, key, weight, n, matches, used, parts))
            members = [(*x[:-1], np.concatenate([x[-1][k] for k in sorted(x[-1])])) for x in members]
            if members[0][0] == WHOLE:
                held += [x[1:] for x in members]
                size += sum(len(x[-1]) for x in members)
                if size >= TILE:
                    yield from solve(held, 0, True)
                    held, size = [], 0
                    trim()
                continue
            ahead = sum(x[0] == LEFT for x in members) if members[0][0] != BOTH else 0
            if ahead < len(members):
                yield from solve([x[1:] for x in members], ahead, False)
            trim()
        if held:
            yield from solve(held, 0, True)
            trim()

    return run


WHOLE, BOTH, LEFT, RIGHT = range(4)


def _tiled(members: DataFrame) -> DataFrame:
    """(to, block, side, ..) rows of members for every tile that they belong to."""
    codes = F.octet_length("tokens") / 8
    families = members.groupBy("family").agg(F.sum(codes).alias("all"))
    members = members.join(families, "family")
    columns = ["key", "part", "weight", "n", "matches", "used", "tokens"]
    one = members.where(f"all <= {TILE}").select(F.col("family").alias("to"), F.lit(WHOLE).alias("side"), *columns)
    large = members.where(f"all > {TILE}").withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3)) + 1e-9).cast("int"))
    # parts of each band, of half a tile each; few numbers a family
    bands = large.groupBy("family", "band").agg(F.ceil(F.sum(codes) * 2 / TILE).cast("int").alias("parts"))
    table = bands.groupBy("family").agg(F.map_from_entries(F.collect_list(F.struct("band", "parts"))).alias("bands"))
    large = large.join(table, "family").withColumn("at", F.expr("cast(pmod(xxhash64(key), bands[band]) as int)"))
    meets = "flatten(transform(array(band - 1, band, band + 1), b -> if(bands[b] is null, array(), transform(sequence(0, bands[b] - 1), p -> named_struct('b', b, 'p', p)))))"
    large = large.withColumn("with", F.explode(F.expr(meets)))
    mine, other = F.struct(F.col("band").alias("b"), F.col("at").alias("p")), F.col("with")
    tile = F.xxhash64("family", F.least(mine, other), F.greatest(mine, other))
    large = large.select(tile.alias("to"), F.when(mine == other, BOTH).when(mine < other, LEFT).otherwise(RIGHT).alias("side"), *columns)
    return one.union(large)


def _classes(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, row, n, key) of docs, and (key, component, n_links) of the classes that link."""
    own = plain(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("doc_id").cast("long"), F.col("text")).alias("row"), "text"))
    size = text_bytes(docs)
    buckets = max(8, size // SHARE)
    asked = dealt(own.mapInArrow(_reader(width, buckets), MESSAGE), size)
    told = dealt(asked.mapInArrow(_counter, MESSAGE), size, hashed=True)
    posted = written(told.mapInArrow(_poster(buckets, num, den), POSTED), "postings", by="kind")
    rows = written(posted.where(f"kind = {DOCS}").selectExpr("inline(docs)"), "documents")
    found = dealt(posted.where(f"kind = {POSTINGS}").select("to", "block", "payload"), size).mapInArrow(_finder(num, den), "a long, b long")
    families = components(found.union(posted.where(f"kind = {LOCAL}").select("key", "other"))).toDF("key", "family")
    weights = rows.where("key is not null").groupBy("key").agg(F.count("*").alias("weight"))
    sets = posted.where(f"kind = {SETS}").select("key", "part", "n", "matches", "used", "tokens").dropDuplicates(["key", "part"])
    members = written(sets.join(families, "key").join(weights, "key"), "members")
    forget(posted)
    tiles = _tiled(members)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // (8 * PARTITION_OF_SETS)))
    tiles = tiles.repartitionById(n, F.pmod(F.xxhash64("to"), F.lit(n)).cast("int")).sortWithinPartitions("to", "side", "key", "part")
    links = written(tiles.mapInArrow(_tiler(num, den), "key long, whole boolean, other long, n_links long"), "links")
    forget(members)
    counts = links.groupBy("key").agg(F.sum("n_links").alias("n_links"))
    parts = components(links.where("not whole").select(F.col("key").alias("a"), F.col("other").alias("b"))).toDF("key", "component")
    labels = links.where("whole").select("key", F.col("other").alias("component")).union(parts)
    return rows, labels.join(counts, "key")


PARTITION_OF_SETS = 64 << 20  # bytes of text of an eighth of a partition of tiles: most texts are in none


def _named(rows: DataFrame, linked_: DataFrame, least) -> DataFrame:
    """(key, lowest, copies, n_links) of all classes: the least of all rows that links connect."""
    first = rows.where("key is not null").groupBy("key").agg(least.alias("least"), F.count("*").alias("copies"))
    joined = first.join(linked_, "key", "left")
    lowest = joined.where("component is not null").groupBy("component").agg(F.min("least").alias("lowest"))
    return joined.join(lowest, "component", "left").select("key", F.coalesce("lowest", "least").alias("lowest"), (F.col("copies") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"))


def join(docs: DataFrame, *, width: int = WIDTH, jaccard: tuple[int, int] = JACCARD, count_links: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text): component_id is the smallest doc_id that
    links reach, the row's own without links. With count_links also n_links, the number of other rows it links with."""
    rows, found = _classes(docs, width, *jaccard)
    out = rows.join(_named(rows, found, F.min("doc_id")), "key", "left")
    columns = ["doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id")]
    return out.select(*columns, *([F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []))


def keep_first(docs: DataFrame, *, width: int = WIDTH, jaccard: tuple[int, int] = JACCARD) -> DataFrame:
    """The rows of docs(doc_id, text, ...) without all but one of each group that links connect: the one with the least
    doc_id stays (of several, or without ids, that with the least hash; of equal rows any). Rows without words all stay.
    Other columns pass through, whatever their names."""
    worded = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows, found = _classes(docs.select("doc_id", "text").where(worded), width, *jaccard)
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    stay = _named(rows, found, best).select(F.col("lowest.row").alias("row")).distinct()
    own = docs.select(F.struct("*").alias("all")).select("all", F.xxhash64(F.col("all.doc_id").cast("long"), F.col("all.text")).alias("row"), F.coalesce(F.col("all.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("worded"))
    # equal rows: one of each; Spark limits each task's rows before it shuffles them
    one = own.where("worded").withColumn("nth", F.row_number().over(Window.partitionBy("row").orderBy("row"))).where("nth = 1")
    return own.where("not worded").select("all").union(one.join(stay, "row", "left_semi").select("all")).select("all.*")


#: Of five words and three quarters, for the whole table documents.
DUCKDB_SQL = r"""WITH RECURSIVE words AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, r, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words
), classes AS MATERIALIZED (SELECT min(r) AS c, s, count(*) AS copies FROM (SELECT r, list_sort(s) AS s FROM sets WHERE len(s) > 0) GROUP BY s
), grams AS MATERIALIZED (SELECT c, len(s) AS n, hash(g) AS g FROM (SELECT c, s, unnest(s) AS g FROM classes)
), links AS MATERIALIZED (
  SELECT a.c AS a, b.c AS b FROM grams AS a JOIN grams AS b ON a.g = b.g AND a.c <> b.c AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT c, c AS x FROM classes UNION SELECT reach.c, links.b FROM reach JOIN links ON reach.x = links.a
), named AS (
  SELECT r.doc_id, r.r, len(r.s) AS n, k.c, k.copies FROM sets AS r LEFT JOIN classes AS k ON list_sort(r.s) = k.s
), least_of AS (SELECT c, min(doc_id) AS least FROM named WHERE c IS NOT NULL GROUP BY c
), tops AS (SELECT reach.c, min(least) AS component FROM reach JOIN least_of ON reach.x = least_of.c GROUP BY reach.c
), counts AS (SELECT a, sum(copies) AS more FROM links JOIN classes ON links.b = classes.c GROUP BY a)
SELECT named.doc_id, CAST(n AS BIGINT) AS n_shingles, coalesce(tops.component, named.doc_id) AS component_id,
  CAST(CASE WHEN named.c IS NULL THEN 0 ELSE named.copies - 1 + coalesce(counts.more, 0) END AS BIGINT) AS n_links
FROM named LEFT JOIN tops ON named.c = tops.c LEFT JOIN counts ON counts.a = named.c"""

"""Substring deduplication: words in passages that an earlier document has too are removed.

A window is `width` consecutive words of one document. A word goes if a window covers it whose word sequence also starts in
a document with a smaller doc_id; windows are judged on the input. Removed words form maximal spans.

Suffix automata of reference shards give matching statistics: at each word, the length of the longest suffix (up to width)
that the reference holds, and the smallest doc_id among the reference texts that hold it. A shard of the whole corpus
would not fit anywhere, so the reference is reduced to what can match, and cut by content:

1. Blocks ask buckets how often each of their windows occurs (exchange.repeats, 4 bytes a window). Windows that occur in
   one document only cannot match and never travel again; the count is never too low.
2. Runs of the other windows are cut where the least code of the shingles (of `anchor` words) within a window changes its
   place, so that equal windows always lie in pieces with the same least shingle. A block merges its equal pieces to one,
   with its smallest doc_id, and sends it to the shard of that shingle. A passage that a third of all documents share
   reaches its shards once a block, and is spread over as many shards as it has least shingles.
3. A shard builds suffix automata of its reference pieces, about `automaton_words` words each, in ascending order of
   their smallest doc_ids: what earlier pieces hold already is left out, so each window is in one automaton. It streams all
   pieces, each window through the automaton that may hold it, and answers each block with the smallest doc_id for every
   window of its pieces. Work is linear in the pieces, however many share a shingle.
4. Blocks mark windows whose smallest doc_id is smaller than their own document's, and keep the words outside.

Automata are shipped with their pieces by a shuffle instead of a broadcast, since all shards together grow with the input.
Words are compared by 64-bit codes of their bytes. Null texts have no words. Rows with a null doc_id are never earlier nor
later than others: nothing is removed from them. Repeated ids are one document each: a window in two rows of one id is not
in a smaller one. Documents shorter than a window stay whole. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .exchange import Blocks, bucket_of, counts_of, repeats
from .words import gram_codes, split_words, word_codes

WIDTH = 13
ANCHOR = 5
AUTOMATON_WORDS = 50_000
NONE = np.iinfo(np.int64).max


class SuffixAutomaton:
    """All factors of the texts added, each state with the smallest owner among the texts that hold its factors."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [NONE]
        self.words = 0

    def add(self, text: list[int], owner: int) -> None:
        """One more text (generalised construction: every text starts at the root)."""
        nxt, link, length, own = self.next, self.link, self.length, self.owner
        last = 0
        for c in text:
            q = nxt[last].get(c)
            if q is not None:
                if length[q] == length[last] + 1:
                    last = q
                else:
                    last = self._clone(last, c, q)
            else:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                own.append(NONE)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = cur
            if owner < own[last]:
                own[last] = owner
        self.words += len(text)

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link = self.next, self.link
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        self.length.append(self.length[p] + 1)
        self.owner.append(NONE)
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        link[q] = new
        return new

    def finish(self) -> SuffixAutomaton:
        """Owners flow from longer factors to their suffixes; call once after the last add()."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if self.owner[s] < self.owner[p]:
                self.owner[p] = self.owner[s]
        return self

    def statistics(self, text: list[int], most: int) -> Iterator[tuple[int, int]]:
        """For each place: length of the longest suffix there that is a factor, `most` at most, and its owner."""
        nxt, link, length, own = self.next, self.link, self.length, self.owner
        state, size = 0, 0
        for c in text:
            while state and c not in nxt[state]:
                state = link[state]
                size = length[state]
            state = nxt[state].get(c, 0)
            size = size + 1 if state else 0
            if size > most:
                size = most
            while length[link[state]] >= size > 0:
                state = link[state]
            yield size, own[state] if size else NONE


def pieces(codes: np.ndarray, counts: np.ndarray, candidate: np.ndarray, width: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows, least shingle and document of the pieces that candidate windows form.

    codes and counts as from word_codes; candidate has a value for each window of all words in a row.
    """
    n = len(codes) - width + 1
    if n <= 0 or not candidate.any():
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64, np.int64))
    grams = gram_codes(codes, anchor)
    span = width - anchor + 1
    least, place = grams[:n].copy(), np.arange(n)
    for j in range(1, span):
        other = grams[j : n + j]
        lower = other < least
        least = np.where(lower, other, least)
        place = np.where(lower, np.arange(j, n + j), place)
    doc = np.repeat(np.arange(len(counts)), counts)[:n]
    at = np.flatnonzero(candidate)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (place[at][1:] != place[at][:-1]) | (doc[at][1:] != doc[at][:-1])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), least[at[first]], doc[at[first]]


def _windows(codes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all windows of all words in a row, and which of them lie within one document."""
    grams = gram_codes(codes, width)
    ends = np.repeat(np.cumsum(counts), counts)[: len(grams)]
    return grams, np.arange(len(grams)) + width <= ends


def _documents(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and counts of words, ids of documents; rows without an id have no words here."""
    codes, counts = word_codes([None if i is None else text for i, text in rows], False)
    return codes, counts, np.array([NONE if i is None else i for i, _ in rows], np.int64)


class _Plan:
    """Pieces of one block, merged: found again alike whenever it is needed."""

    def __init__(self, rows: list, answered: list, width: int, anchor: int):
        self.codes, self.counts, self.ids = _documents(rows)
        grams, whole = _windows(self.codes, self.counts, width)
        unique, where = np.unique(grams[whole], return_inverse=True)
        candidate = np.zeros(len(grams), bool)
        candidate[whole] = (counts_of(answered) > 1)[where] if len(unique) else False
        self.first, self.size, self.least, self.doc = pieces(self.codes, self.counts, candidate, width, anchor)
        content = [(self.size[k], grams[a : a + s].tobytes()) for k, (a, s) in enumerate(zip(self.first.tolist(), self.size.tolist()))]
        seen: dict = {}
        self.of = np.array([seen.setdefault(x, len(seen)) for x in content], np.int64)
        self.unique = np.unique(self.of, return_index=True)[1]  # a piece of each content
        self.owner = np.full(len(seen), NONE)
        np.minimum.at(self.owner, self.of, self.ids[self.doc])


def _block_windows(rows: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    codes, counts, _ = _documents(rows)
    grams, whole = _windows(codes, counts, width)
    return np.unique(grams[whole], return_counts=True)


def _runs(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs, of which same tells whether a place goes on with the one before."""
    starts = np.flatnonzero(~same)
    return starts, np.append(starts[1:], len(same))


def _stream(group: list[tuple[bytes, int]], least: dict[bytes, np.ndarray], width: int, automaton_words: int) -> None:
    """Smallest owner of each window of the group's (text, owner), which are in ascending order of owners wherever windows
    are equal. A window is put into one automaton only, with the first text that has it, so references and streams grow
    with the group, not with its square; a text is streamed in runs of windows of the same automaton."""
    texts = [np.frombuffer(text, np.uint64) for text, _ in group]
    sizes = np.array([len(x) for x in texts])
    words, count = np.concatenate(texts), sizes - width + 1
    at = np.repeat(np.cumsum(sizes) - sizes - np.cumsum(count) + count, count) + np.arange(count.sum())  # where windows start
    of = np.repeat(np.arange(len(texts)), count)
    unique, first, which = np.unique(gram_codes(words, width)[at], return_index=True, return_inverse=True)
    new = np.zeros(len(at), bool)
    new[first] = True
    fresh = np.flatnonzero(new)
    starts, ends = _runs(np.concatenate(([False], (np.diff(fresh) == 1) & (np.diff(of[fresh]) == 0))))
    run = np.cumsum(ends - starts + width - 1) // automaton_words  # the automaton of each run
    number = np.empty(len(unique), np.int64)
    number[which[fresh]] = np.repeat(run, ends - starts)
    lies = number[which]
    a, z = _runs(np.concatenate(([False], (np.diff(lies) == 0) & (np.diff(of) == 0))))
    by = np.argsort(lies[a], kind="stable")
    a, z = a[by], z[by]
    found, k, j = np.full(len(at), NONE), 0, 0
    while k < len(starts):
        automaton, own = SuffixAutomaton(), run[k]
        while k < len(starts) and run[k] == own:
            x, y = fresh[starts[k]], fresh[ends[k] - 1]
            automaton.add(words[at[x] : at[y] + width].tolist(), group[of[x]][1])
            k += 1
        automaton.finish()
        while j < len(a) and lies[a[j]] == own:
            text = words[at[a[j]] : at[z[j] - 1] + width].tolist()
            found[a[j] : z[j]] = [o if size == width else NONE for size, o in automaton.statistics(text, width)][width - 1 :]
            j += 1
    for (text, _), part in zip(group, np.split(found, np.cumsum(count)[:-1])):
        least[text] = part


def _answer(width: int, automaton_words: int):
    def answer(bucket: int, asked: list) -> Iterator:
        parts = [(block, *pickle.loads(payload)) for block, payload in asked]
        texts: dict[bytes, tuple[int, int]] = {}  # content to its least shingle and smallest owner
        for _, sizes, words, owners, shingles in parts:
            at = 0
            for size, owner, shingle in zip(sizes.tolist(), owners.tolist(), shingles.tolist()):
                text = words[at : at + size].tobytes()
                at += size
                if text not in texts or owner < texts[text][1]:
                    texts[text] = shingle, owner
        least: dict[bytes, np.ndarray] = {}
        # equal windows have equal least shingles: pieces of one shingle meet, whole groups share an automaton
        group: list[tuple[bytes, int]] = []
        words_held, last = 0, None
        for text, (shingle, owner) in sorted(texts.items(), key=lambda x: x[1]):
            if shingle != last and words_held >= automaton_words // 2:
                _stream(group, least, width, automaton_words)
                group, words_held = [], 0
            group.append((text, owner))
            words_held, last = words_held + len(text) // 8, shingle
        if group:
            _stream(group, least, width, automaton_words)
        for block, sizes, words, _, _ in parts:
            out, at = [], 0
            for size in sizes.tolist():
                out.append(least[words[at : at + size].tobytes()])
                at += size
            yield block, (bucket, np.concatenate(out).tobytes())

    return answer


def dedup(docs: DataFrame, *, width: int = WIDTH, anchor: int = ANCHOR, automaton_words: int = AUTOMATON_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) for each row of docs(doc_id, text): spans are the maximal removed
    [start, end) in words, kept the other words joined by one space."""
    from pyspark.sql import functions as F

    blocks = Blocks(docs.select(F.col("doc_id").cast("long"), "text"))
    counts = repeats(blocks, lambda rows: _block_windows(rows, width))
    buckets = blocks.buckets(1 << 22)

    def send(block: int, rows: list, answered: list) -> Iterator:
        plan = _Plan(rows, answered, width, anchor)
        to = bucket_of(plan.least[plan.unique], buckets).astype(np.int64)
        order = np.argsort(to, kind="stable")
        ends = np.flatnonzero(np.diff(to[order], append=-1)) + 1
        for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
            own = plan.unique[order[a:b]]
            sizes = plan.size[own] + width - 1
            words = np.concatenate([plan.codes[f : f + s] for f, s in zip(plan.first[own].tolist(), sizes.tolist())])
            yield int(to[order[a]]), pickle.dumps((sizes.astype(np.int32), words, plan.owner[plan.of[own]], plan.least[own]), 5)

    least = blocks.ask(send, _answer(width, automaton_words), buckets, counts)

    def keep(x) -> Iterator[tuple]:
        _, rows, (answered, owners) = x
        plan = _Plan(rows, answered, width, anchor)
        to = bucket_of(plan.least[plan.unique], buckets).astype(np.int64)
        order = np.argsort(to, kind="stable")
        told = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(raw, np.int64) for _, raw in sorted(owners, key=lambda y: y[0]))])
        starts = np.empty(len(order), np.int64)
        starts[order] = np.cumsum(plan.size[plan.unique[order]]) - plan.size[plan.unique[order]]
        goes = np.zeros(len(plan.codes) + 1, np.int64)  # differences of the number of covering windows
        if len(plan.first):
            window = np.repeat(plan.first - np.cumsum(plan.size) + plan.size, plan.size) + np.arange(plan.size.sum())
            piece = np.repeat(np.arange(len(plan.first)), plan.size)
            smallest = told[starts[plan.of[piece]] + window - plan.first[piece]]
            hit = window[smallest < plan.ids[plan.doc[piece]]]
            np.add.at(goes, hit, 1)
            np.add.at(goes, hit + width, -1)
        covered = np.cumsum(goes[:-1]) > 0
        at = 0
        for (doc_id, text), n in zip(rows, plan.counts.tolist()):
            words = split_words(text)
            own = covered[at : at + n] if n else np.zeros(len(words), bool)
            at += n
            edges = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0))
            if len(edges):
                words = compress(words, (~own).tolist())
            yield doc_id, len(own), int(own.sum()), edges.reshape(-1, 2).tolist(), b" ".join(words).decode("utf-8", "surrogatepass")

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("kept", T.StringType())])
    return blocks.spark.createDataFrame(blocks.each(keep, counts, least), schema, verifySchema=False)


DUCKDB_SQL = r"""WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS t FROM g),
m AS (SELECT t, min(doc_id) AS m FROM h GROUP BY t),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM h JOIN m USING (t) WHERE m.m < h.doc_id),
c AS (SELECT doc_id, list(p) AS p, count(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(c.n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN c.n IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(c.p, i)), lambda i: w[i]), ' ') END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id)"""

"""Language-model scores of documents by a weighted backoff automaton.

Tokens are words, lower-cased in A-Z, then one end token for each document; a start token is context only. The model
interpolates absolutely discounted n-grams down to unigrams with an additive constant:

    p(w | h) = max(c(hw) - D, 0) / c(h) + D * T(h) / c(h) * p(w | h without its first word),
    p(w)     = (c(w) + a) / (N + a * (V + 1)),

T(h): different words after h in training; D from the numbers of n-grams seen once and twice. Unknown words share the one
class that V + 1 adds, so probabilities sum to 1 over V words and that class. As an automaton: a state for each context h
seen in training, an arc for each seen hw with log10 p(w | h), and a failure arc with log10(D * T(h) / c(h)) to the state
of the shorter context. One left-to-right traversal carries the state and adds up weights.

The whole automaton grows with the corpus, so no machine holds it. Every block asks for the part that its own documents
can reach. First question: the training counts of its n-grams. Second question: the counts of its words, and T(h) of its
contexts, as a sum over n-grams, of each of which exactly one block is told to be the owner; a context seen once has
one follower and needs no question. The block then knows every arc and failure arc that its texts could take, by the
places where they stand, and traverses its documents, many segments of texts in step. The state after a word is the
longest context that ends there and goes on in training, so a segment's first state is found by n - 1 words of run-up.
Counts are of the whole of the training rows. Words travel by all 64 bits of their codes, so N, V and all that follows from words alone are of
each word's own count; longer n-grams travel by 40 bits of their code and a bucket, so about one in a million shares its count with another.

Null and empty texts hold the end token alone. Rows with a null doc_id are held out (their id's text is empty) and scored.
Repeated rows count as often as they occur. Without training rows N = V = 0 and every token has probability 1. Empty
tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import Blocks, cuts, entire, fit, narrow, pack, unpack, widened
from .words import _BASE, _GOLDEN, mix, ranked, trim, word_codes

ORDER = 3
ADDED = 0.1
FOLDS = 10
SEGMENT = 256  # tokens of a text traversed in step with other segments
PARTS = 4  # blocks of an input partition: larger ones repeat fewer n-grams
START, END = mix(np.array([11, 13], np.uint64) * _GOLDEN)


def held_out(doc_id: int | None, folds: int) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % folds == 0


class _Grams:
    """The different n-grams of one length of a block: sorted codes, training counts, a place of each, and which one starts at
    each place (-1 where one would leave its document)."""

    def __init__(self, codes: np.ndarray, place: np.ndarray, n: int, trains: np.ndarray):
        self.codes, which = ranked(codes)
        self.at = np.full(n, -1, np.int32)
        self.at[place] = which
        self.place = np.empty(len(self.codes), np.int32)
        self.place[which] = place
        self.counts = np.bincount(which[trains[place]], minlength=len(self.codes)).astype(np.int64)


class _Block:
    """What a block asks for, found again alike in each round. grams[k]: its k-grams; tokens: start, words, end of each text."""

    def __init__(self, rows: list, order: int, folds: int):
        codes, counts = word_codes([x for _, x in rows], True)
        self.order, self.sizes = order, counts + 2
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        tokens = np.empty(int(self.sizes.sum()), np.uint64)
        word = np.ones(len(tokens), bool)
        word[self.starts], word[self.ends - 1] = False, False
        tokens[word], tokens[self.starts], tokens[self.ends - 1] = codes, START, END
        del codes, word
        self.doc = np.repeat(np.arange(len(rows), dtype=np.int32), self.sizes)
        self.out = np.array([held_out(i, folds) for i, _ in rows], bool)
        trains, n = ~self.out[self.doc] if len(rows) else np.empty(0, bool), len(tokens)
        self.grams, total = {}, np.zeros(n, np.uint64)
        for k in range(1, order + 1):
            if len(total) and k > 1:
                total = total[:-1]
            total = total * _BASE + tokens[k - 1 :] if n >= k else total[:0]
            place = np.flatnonzero(self.doc[: len(total)] == self.doc[k - 1 :]).astype(np.int32) if k > 1 else np.arange(len(total), dtype=np.int32)
            raw = total[place]
            self.grams[k] = _Grams(raw if k == 1 else mix(raw + np.uint64(k * int(_GOLDEN) % 2**64)), place, n, trains)
        self.start = np.zeros(len(self.grams[1].codes), bool)
        self.start[self.grams[1].at[self.starts]] = True
        self.last = np.zeros(n, bool)
        self.last[self.ends - 1] = True


def _asked(columns: list[tuple[np.ndarray, ...]], buckets: int, words: bool = False) -> Iterator[tuple[int, bytes]]:
    """Messages of (codes, numbers ..) of each length, the codes sorted; numbers shrink. words: the first are codes of words, which travel whole."""
    at = [cuts(x[0], buckets) for x in columns]
    for b in range(buckets):
        if any(own[b] < own[b + 1] for own in at):
            out = []
            for k, (own, (codes, *numbers)) in enumerate(zip(at, columns)):
                part = slice(own[b], own[b + 1])
                out += [*(entire(codes[part]) if words and not k else narrow(codes[part], b, buckets)), *(fit(x[part]) for x in numbers)]
            yield b, pack(*out)


def _totals(lengths: list[int]):
    """Answers to _asked(), where columns[i] has lengths[i] numbers: whether the block is the first that has a code, and the
    sums of the numbers over all blocks."""

    def answer(bucket: int, asked: list) -> Iterator:
        parts = [(block, unpack(payload)) for block, payload in sorted(asked)]
        told: list[list] = [[] for _ in parts]
        at = 0
        for n in lengths:
            tags = [widened(x[at], x[at + 1]) for _, x in parts]
            size = [len(x) for x in tags]
            together = np.concatenate([*tags, np.empty(0, np.uint64)])
            by = np.argsort(together, kind="stable")  # of equal tags the first block comes first
            new = np.concatenate(([True], together[by][1:] != together[by][:-1])) if len(by) else np.empty(0, bool)
            owner = np.empty(len(by), bool)
            owner[by] = new
            sums = []
            for k in range(n):
                total = np.empty(len(by), np.int64)
                if len(by):
                    numbers = np.concatenate([x[at + 2 + k].astype(np.int64) for _, x in parts])[by]
                    total[by] = np.repeat(np.add.reduceat(numbers, np.flatnonzero(new)), np.diff(np.append(np.flatnonzero(new), len(by))))
                sums.append(total)
            a = 0
            for own, m in zip(told, size):
                own += [np.packbits(owner[a : a + m]), np.array([m]), *(fit(x[a : a + m]) for x in sums)]
                a += m
            at += 2 + n
        for (block, _), own in zip(parts, told):
            yield block, (bucket, pack(*own))

    return answer


def _told(answers: list, lengths: list[int]) -> list[list[np.ndarray]]:
    """Of each length: whether the block owns its codes, and the sums, in the order of the codes."""
    parts = [unpack(x) for _, x in sorted(answers, key=lambda y: y[0])]
    out, at = [], 0
    for n in lengths:
        owner = [np.unpackbits(x[at], count=int(x[at + 1][0])).astype(bool) for x in parts]
        out.append([np.concatenate([np.empty(0, bool), *owner]), *(np.concatenate([np.empty(0, np.int64), *(x[at + 2 + k].astype(np.int64) for x in parts)]) for k in range(n))])
        at += 2 + n
    return out


class Automaton:
    """The part of the model that the texts of a block can reach. A state is a context: the last `length` tokens; 0 is the root.
    Arcs and contexts are found by the places where they start."""

    def __init__(self, block: _Block, totals: dict[int, np.ndarray], follow: dict[int, np.ndarray], model: dict):
        """totals[k]: training counts of the k-grams; follow[k]: T(h) of those of them that are contexts."""
        order, n, v, added, grams = block.order, model["N"], model["V"], model["added"], block.grams
        self.block, self.totals = block, totals
        unigram = (totals[1] + added) / (n + added * (v + 1)) if n else np.ones(len(totals[1]))
        self.live, self.arc, self.fail = {}, {}, {}
        self.arc[1] = np.log10(unigram)  # of the root: there for all tokens
        lower = unigram
        for k in range(2, order + 1):
            own, short, count, t = grams[k], grams[k - 1], totals[k - 1], follow[k - 1]
            live = (t > 0) & (count > 0)
            mass = np.zeros(len(count))
            mass[live] = model["D"][k] * t[live] / count[live]
            self.live[k - 1] = live
            with np.errstate(divide="ignore"):
                self.fail[k - 1] = np.log10(mass)
            seen = np.flatnonzero(totals[k] > 0)
            place = own.place[seen]
            head = short.at[place]
            weight = np.zeros(len(totals[k]))
            weight[seen] = np.maximum(totals[k][seen] - model["D"][k], 0) / count[head] + mass[head] * lower[short.at[place + 1]]
            with np.errstate(divide="ignore"):
                self.arc[k] = np.log10(weight)  # of unseen ones: no arc
            lower = weight

    def _state(self, place: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length of the longest context that ends with the token at each place and begins at `first` or later."""
        out = np.zeros(len(place), np.int64)
        for k in range(1, self.block.order):
            start = np.maximum(place - k + 1, 0)
            fits = place - k + 1 >= first
            out[fits & self.live[k][self.block.grams[k].at[start]]] = k
        return out

    def step(self, state: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States after the tokens at these places of texts that begin at `first`, and the weights added on the way."""
        added, state = np.zeros(len(state)), state.copy()
        open_ = np.arange(len(state))
        while len(open_):
            going = []
            for length in range(self.block.order):
                own = open_[state[open_] == length]
                if not len(own):
                    continue
                gram = self.block.grams[length + 1].at[place[own] - length]
                hit = self.totals[length + 1][gram] > 0 if length else np.ones(len(own), bool)
                added[own[hit]] += self.arc[length + 1][gram[hit]]
                lost = own[~hit]
                if len(lost):  # what goes on in training goes on without its first word too
                    added[lost] += self.fail[length][self.block.grams[length].at[place[lost] - length]]
                    state[lost] = length - 1
                    going.append(lost)
            open_ = np.concatenate(going) if going else open_[:0]
        return self._state(place, first), added

    def scores(self) -> np.ndarray:
        """log10 probability of each text: segments of all texts advance by one token at a time."""
        block, run_up = self.block, self.block.order - 1
        body = block.starts + 1  # the start token is not scored
        parts = -(-(block.ends - body) // SEGMENT)
        doc = np.repeat(np.arange(len(parts)), parts)
        k = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first = body[doc] + k * SEGMENT
        stop = np.minimum(first + SEGMENT, block.ends[doc])
        start = block.starts[doc]
        state = np.zeros(len(first), np.int64)
        for j in range(run_up, 0, -1):  # words before the segment, from the farthest
            have = np.flatnonzero(first - j >= start)
            state[have] = self._state(first[have] - j, start[have])
        total = np.zeros(len(first))
        by = np.argsort(first - stop, kind="stable")  # the longest first
        sizes = (stop - first)[by]
        for j in range(int(sizes[0]) if len(sizes) else 0):
            now = by[: np.searchsorted(-sizes, -j, "left")]
            state[now], added = self.step(state[now], first[now] + j, start[now])
            total[now] += added
        return np.bincount(doc, total, len(parts)) if len(parts) else np.zeros(0)


def score(docs: DataFrame, *, order: int = ORDER, folds: int = FOLDS, added: float = ADDED) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs(doc_id, text).

    Rows whose crc32 of the id's text is a multiple of folds are held out of training. base_score is by the unigrams alone.
    """
    if order < 2:
        raise ValueError("order must be 2 or more")
    blocks = Blocks(docs.select(F.col("doc_id").cast("long"), "text"), PARTS)
    buckets = blocks.buckets()
    long = range(2, order + 1)  # lengths asked for first
    ones, twos = [1] * (order - 1), [2, *[1] * (order - 2)]

    def ask_grams(block: int, rows: list) -> Iterator:
        own = _Block(rows, order, folds)
        return _asked([(own.grams[k].codes, own.grams[k].counts) for k in long], buckets)

    grams = blocks.ask(ask_grams, _totals(ones), buckets)

    def unsure(totals: np.ndarray) -> np.ndarray:
        """Contexts whose followers have to be asked for: one that is seen once has one."""
        return totals > 1

    def ask_heads(block: int, rows: list, answered: list) -> Iterator:
        own, told = _Block(rows, order, folds), _told(answered, ones)
        follow = {}
        for k, (owner, totals) in zip(long, told):
            new = own.grams[k].place[owner & (totals > 0)]
            follow[k - 1] = np.bincount(own.grams[k - 1].at[new], minlength=len(own.grams[k - 1].codes))
        columns = [(own.grams[1].codes, own.grams[1].counts, follow[1])]
        for k, (_, totals) in zip(range(2, order), told):
            some = unsure(totals)
            columns.append((own.grams[k].codes[some], follow[k][some]))
        return _asked(columns, buckets, words=True)

    heads = blocks.ask(ask_heads, _totals(twos), buckets, grams)

    def numbers(it) -> Iterator[np.ndarray]:
        """N and V, words and starts together, then the n-grams seen once and twice of each length, of those that blocks own."""
        out = np.zeros(2 + 2 * (order - 1), np.int64)
        for _, (kind, (_, payload)) in it:
            for k, (owner, totals, *_) in enumerate(_told([(0, payload)], twos if kind else ones)):
                if kind and not k:
                    out[:2] += totals[owner].sum(), (totals[owner] > 0).sum()
                elif not kind:
                    out[2 + 2 * k : 4 + 2 * k] += (totals[owner] == 1).sum(), (totals[owner] == 2).sum()
        trim()
        yield out

    id_text = F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit(""))
    texts = docs.where(F.crc32(id_text.cast("binary")) % folds != 0).count()  # training rows: their starts are no words
    sums = blocks.home(grams, heads).mapPartitions(numbers).treeReduce(lambda a, b: a + b)
    discounts = {k: a / (a + 2 * b) if a and b else 0.5 for k, (a, b) in zip(long, sums[2:].reshape(-1, 2).tolist())}
    model = {"N": int(sums[0]) - texts, "V": int(sums[1]) - bool(texts), "D": discounts, "added": added}

    def traverse(x) -> Iterator[tuple]:
        _, rows, (answered, told) = x
        if not rows:
            return
        own = _Block(rows, order, folds)
        totals = {k: x for k, (_, x) in zip(long, _told(answered, ones))}
        (_, totals[1], words), *others = _told(told, twos)
        follow = {1: words}
        for k, (_, asked) in zip(range(2, order), others):
            follow[k] = np.where((totals[k] == 1) & ~own.last[own.grams[k].place + k - 1], 1, 0)
            follow[k][unsure(totals[k])] = asked
        automaton = Automaton(own, totals, follow, model)
        total = automaton.scores()
        scored = np.ones(len(own.doc), bool)
        scored[own.starts] = False
        doc, word = own.doc[scored], own.grams[1].at[scored]
        base = np.bincount(doc, automaton.arc[1][word], len(rows))
        known = np.bincount(doc, totals[1][word] > 0, len(rows)).astype(int)
        for i, (doc_id, _) in enumerate(rows):
            yield doc_id, bool(own.out[i]), int(own.sizes[i] - 1), int(known[i]), model["N"], float(base[i]), float(total[i])

    names = [("doc_id", T.LongType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    return blocks.spark.createDataFrame(blocks.each(traverse, grams, heads), T.StructType([T.StructField(*x) for x in names]), verifySchema=False)

"""Toxicity of texts: a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lower-cases, takes accents off, maps look-alike letters of other scripts and digits that stand for letters to one
skeleton, drops invisible characters and turns everything else into spaces. Entries are whole words or word beginnings with
a weight (log odds of toxic against other documents); exception phrases cancel the hits that they cover. The sums of
weights, normalised by length, give a score from 0 to 1 by a logistic curve. The text is the only input of a score.

Null and empty texts have no hits and get the score of a text without hits. Repeated rows get equal scores. Without any
toxic example, or without any other one, all scores are the share of toxic examples (0 without examples). Rows of labels
with a null id or null label are left out; an id with several labels counts as toxic if any says so. Extra columns pass
through untouched.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written
from .words import slices, trim

#: Characters that look like, or stand for, a Latin letter. i, l, 1 and | fall together.
LOOK_ALIKE = {
    "a": "4@αаɑ", "b": "8вьβ", "c": "сϲ", "d": "ԁ", "e": "3еε", "g": "ɡ9", "h": "һн", "j": "ј", "k": "кκ", "l": "1|iіıιӏ",
    "m": "м", "n": "пη", "o": "0оοσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "5$ѕ", "t": "7тτ", "u": "υц", "v": "νѵ", "w": "ѡԝω",
    "x": "хχ", "y": "уγ", "z": "2",
}
#: Phrases in which a word of the lexicon is harmless; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "class clown", "stupid question", "pond scum", "sore loser")
SAMPLE = 20_000  # labelled documents that the lexicon and the curve are fitted on, at most
PREFIXES = (4, 5, 6, 7, 8)
MIN_TOXIC, MIN_SHARE = 5, 0.01  # toxic documents, and share of them, that an entry must occur in
HELD = 60_000  # counts of entries that a task holds before it passes them on
MIN_WEIGHT, FIRST_WEIGHT = 2.0, 0.2  # log odds of an entry, and before exceptions are known


class _Fold(dict):
    def __missing__(self, code: int) -> str | None:
        self[code] = out = _folded(chr(code))
        return out


_SKELETON = {x: letter for letter, alike in LOOK_ALIKE.items() for x in alike}


def _folded(ch: str) -> str:
    if ch in _SKELETON:
        return _SKELETON[ch]
    out = []
    for x in unicodedata.normalize("NFKD", ch.lower()):
        kind = unicodedata.category(x)
        if x in _SKELETON:
            out.append(_SKELETON[x])
        elif kind[0] == "L":
            out.append(x)
        elif kind[0] == "N" or kind in ("Mn", "Me", "Cf"):
            continue
        else:
            out.append(" ")
    return "".join(out)


_FOLD = _Fold()


def fold(text: str | None) -> str:
    """The folded text with a space at either end."""
    return f" {text.translate(_FOLD)} " if text else "  "


@dataclass
class Model:
    """entries: " word " or " beginning" to weight. curve: weights of features() and the intercept, last."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: list[float] = field(default_factory=lambda: [0.0, 0.0, 0.0, -math.inf])

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for x, weight in self.entries.items():
            found.add_word(x, (weight, len(x)))
        for x in self.exceptions:
            found.add_word(x, (0.0, len(x)))
        if len(found):
            found.make_automaton()
        return found


def matches(folded: str, matcher) -> list[tuple[int, int, float]]:
    """(start, end, weight) of all matched entries, without those in words within exceptions."""
    found, safe = [], []
    if len(matcher):
        for end, (weight, size) in matcher.iter(folded):
            (found if weight else safe).append((end - size + 1, end + 1, weight))
    if not safe:
        return found
    # of the exceptions that begin at or before a match, the one that ends last
    safe.sort()
    starts, ends = [a for a, _, _ in safe], list(accumulate((b for _, b, _ in safe), max))
    return [x for x in found if not (k := bisect_right(starts, x[0])) or x[0] >= ends[k - 1] - 1]


def hits(folded: str, matcher) -> list[tuple[int, float]]:
    """(start, weight) of the words that entries match, with the heaviest entry of each."""
    best: dict[int, float] = {}
    for start, _, weight in matches(folded, matcher):
        best[start] = max(weight, best.get(start, weight))
    return sorted(best.items())


def features(folded: str, matcher) -> tuple[float, float, float]:
    """Saturating sum of weights, sum a root of the length, heaviest hit."""
    weights = [w for _, w in hits(folded, matcher)]
    if not weights:
        return 0.0, 0.0, 0.0
    total = math.fsum(weights)
    return math.log1p(total), total / math.sqrt(10 + len(folded) / 6), max(weights)


def _score(x: tuple[float, float, float], curve: list[float]) -> float:
    z = curve[3] + sum(a * b for a, b in zip(x, curve))
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is a multiple of folds; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Model:
    """A model from docs(doc_id, text) and labels(doc_id, label), without held-out rows.

    `sample` bounds the labelled documents it reads: those with the smallest hashes of their ids. Three quarters of them
    give the lexicon, the rest the curve. Equal texts count once. The sample also bounds the lexicon, as an entry stands in
    MIN_TOXIC toxic documents and MIN_SHARE of them or more, and the learned exceptions, each of which stands in three.
    """
    fold_of = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    chosen = (
        labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # `sample` rows of 12 bytes at most
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    texts = texts.groupBy(F.xxhash64("text").alias("key"), F.md5("text").alias("key2")).agg(F.min_by("text", "doc_id").alias("text"), F.max("y").alias("y"), F.min(fold_of == 4).alias("curve"))
    texts = written(texts.select("text", "y", "curve"), "toxicity-sample")
    totals = {y: n for y, n in texts.groupBy("y").count().collect()}
    n_toxic, n_other = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_other:
        share = n_toxic / max(1, n_toxic + n_other)
        return Model({}, [], [0.0, 0.0, 0.0, math.inf if share == 1 else -math.inf])
    fit_on, curve_on = texts.where("not curve"), texts.where("curve")
    toxic, other = (max(1, fit_on.where(F.col("y") == y).count()) for y in (1, 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic_in, other_in = Counter(), Counter()

        def table() -> pa.RecordBatch:
            keys = list(toxic_in.keys() | other_in.keys())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([toxic_in[k] for k in keys], pa.int64()), pa.array([other_in[k] for k in keys], pa.int64())], ["entry", "t", "c"])

        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(fold(text).split())
                keys = {f" {w} " for w in words}
                for n in PREFIXES:
                    keys.update(f" {w[:n]}" for w in words if len(w) >= n)
                (toxic_in if y else other_in).update(keys)
                if len(toxic_in) + len(other_in) > HELD:
                    yield table()
                    toxic_in.clear()
                    other_in.clear()
        yield table()
        trim()

    weight = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("c") + 0.5) / (other + 1.0))
    found = (
        fit_on.select("text", "y").mapInArrow(count, "entry string, t long, c long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        .where(F.col("t") >= max(MIN_TOXIC, MIN_SHARE * toxic)).withColumn("w", weight).where(F.col("w") >= FIRST_WEIGHT).orderBy(F.desc("w"), "entry").collect()
    )
    model = Model(_pruned({r.entry: (r.t, r.c, r.w) for r in found}), sorted({f" {fold(x).strip()} " for x in exceptions}))
    model.exceptions += _learned_exceptions(fit_on, model)
    model.entries = _reweighted(fit_on, model, weight)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            rows = [features(fold(x), matcher) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.float64()) for k in range(3)), batch.column(1)], ["a", "b", "c", "y"])

    measured = np.array(curve_on.select("text", "y").mapInArrow(measure, "a double, b double, c double, y int").collect(), float).reshape(-1, 4)  # `sample` rows at most
    model.curve = _logistic(measured[:, :3], measured[:, 3], (n_toxic + 0.5) / (n_toxic + n_other + 1))
    return model


def _pruned(found: dict[str, tuple[int, int, float]]) -> dict[str, float]:
    """Without beginnings that stand nearly always for one longer entry, then without entries that a beginning covers
    about as purely."""
    beginnings = lambda x: [y for n in range(min(PREFIXES) + 1, len(x)) if (y := x[:n]) in found and not y.endswith(" ")]
    narrow = {y for x, (t, _, _) in found.items() for y in beginnings(x) if t >= 0.9 * found[y][0]}
    kept = {}
    for entry, (t, c, w) in sorted(found.items(), key=lambda x: (-x[1][2], x[0])):
        if entry in narrow or any(y not in narrow and found[y][1] / found[y][0] <= c / t + 0.02 for y in beginnings(entry)):
            continue
        kept[entry] = w
    return kept


_NEXT = re.compile(r" *([^ ]+) *([^ ]*)")


def neighbours(folded: str, start: int) -> tuple[str, str, str]:
    """The word before the one that follows the space at `start`, that word, and the next; empty where there is none."""
    end = start
    while end and folded[end - 1] == " ":
        end -= 1
    found = _NEXT.match(folded, start)
    return folded[folded.rfind(" ", 0, end) + 1 : end], found[1], found[2]


def _learned_exceptions(texts: DataFrame, model: Model) -> list[str]:
    """Pairs of a matched word and a neighbour that stand in three or more documents, most of them not toxic."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, seen = model.matcher(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded, found = fold(text), set()
                for start, _ in hits(folded, matcher):
                    before, own, after = neighbours(folded, start)
                    if after:
                        found.add(f" {own} {after} ")
                    if before:
                        found.add(f" {before} {own} ")
                seen.update((x, y) for x in found)
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in seen], pa.string()), pa.array([y for _, y in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["pair", "y", "n"])

    counted = texts.select("text", "y").mapInArrow(pairs, "pair string, y int, n long").groupBy("pair").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("c"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("t"))
    return [r.pair for r in counted.where("c >= 3 and c > 4 * t").orderBy(F.desc("c"), "pair").collect()]


def _reweighted(texts: DataFrame, model: Model, weight: Column) -> dict[str, float]:
    """Entries that weigh enough, with weights by their matches outside exceptions."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, seen = model.matcher(), Counter()
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                folded = fold(text)
                seen.update((x, y) for x in {folded[a:b] for a, b, _ in matches(folded, matcher)})
        columns = [x for x, _ in seen], [n * (y == 1) for (_, y), n in seen.items()], [n * (y == 0) for (_, y), n in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()))], ["entry", "t", "c"])

    counted = texts.select("text", "y").mapInArrow(count, "entry string, t long, c long").groupBy("entry").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    return {r.entry: r.w for r in counted.withColumn("w", weight).where(F.col("w") >= MIN_WEIGHT).orderBy("entry").collect()}  # no more than the entries that are there


def _logistic(x: np.ndarray, y: np.ndarray, share: float) -> list[float]:
    """Ridge logistic regression by Newton steps; weights not below 0, as more hits never make a text milder."""
    prior = math.log(share / (1 - share))
    if len(set(y.tolist())) < 2:
        return [1.0, 0.0, 0.0, min(prior, -1.0)]
    scale = np.maximum(x.std(axis=0), 1e-9)
    a = np.column_stack((x / scale, np.ones(len(x))))
    w, ridge = np.zeros(4), np.diag([1.0, 1.0, 1.0, 1e-3])
    active = np.ones(4, bool)
    while True:
        w[:] = 0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            b = a[:, active]
            step = np.linalg.solve(b.T @ (b * (p * (1 - p))[:, None]) + ridge[np.ix_(active, active)], b.T @ (y - p) - (ridge @ w)[active])
            w[active] += step
            if np.abs(step).max() < 1e-8:
                break
        low = active & (w < 0)
        low[3] = False
        if not low.any():
            break
        active &= ~low
    return [*(w[:3] / scale).tolist(), float(w[3])]


def scorer(model: Model):
    """A column function from text to score."""
    spark_model = (model.entries, model.exceptions, model.curve)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = Model(*spark_model)
        matcher = made.matcher()
        for texts in batches:
            out = []
            for a, b in slices(texts):
                out += [_score(features(fold(x), matcher), made.curve) for x in texts.slice(a, b - a).to_pylist()]
            yield pa.array(out, pa.float64())
            del texts, out
            trim()

    return score


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the column score_col, which replaces one of that name."""
    return docs.withColumn(score_col, scorer(model)(F.col(text_col)))


def keep_below(docs: DataFrame, model: Model, threshold: float = 0.5, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that score less than the threshold, with the columns of docs, whatever their names."""
    scored = docs.select(F.struct("*").alias("all")).withColumn("score", scorer(model)(F.col(f"all.{text_col}")))
    return scored.where(F.col("score") < threshold).select("all.*")

"""Spelling variant grouping: forward and reversed sorted dictionaries, whose shared halves are range-scanned for words one edit apart.

Of two words that differ by one inserted, deleted or replaced code point, the shorter with m of them, let the edit lie behind their common
beginning, of c code points. If c >= m // 2 the first half is intact, else the second. So each word goes into a dictionary sorted by its
beginning and one sorted by its reversed end, as a word of length m and as one that is longer than m = length - 1 by one. Words
that share a half are a block, a range of a sorted dictionary.

A block stands for the pairs with low <= c < high: it holds the words that agree before `low` and behind `high`. A block of more than BLOCK words
is subdivided by the middle of low and high, into words that agree up to there and words that agree from there on, until it is small
enough or its words agree in all places but one, of which the alphabet allows few. Every pair lies in exactly one block by its c, so
nothing is found twice, and blocks of any skew end small. In a block words are verified, and only what a word finds leaves it: how many near
words, and the most frequent.

The dictionaries are cut into ranges by key, so a block is read by one task; a task holds blocks of about CELLS compared pairs at a time. Words are counted by DataFrame functions,
combined before the shuffle, so a word that fills a third of the corpus reaches its counter once a task. Roots come from
pointer jumping over the words that have a form: the distance doubles each round, and counts double along each form, so a few rounds do.

Null texts have no words, null ids count as empty text. Words of any length are whole. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crc import crc32_sql
from .shared import forget, written
from .words import trim

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 5, 3
EVERY = 97  # runs whose hash it divides lose a code point
BLOCK = 96  # words, beyond which a block is subdivided
CELLS = 1 << 20  # pairs that are compared at once, about
BYTES = 1 << 26  # of the letters of those pairs, at most

FOUND = "word string, n_near long, minus long, form string"


def runs(docs: DataFrame) -> DataFrame:
    """(word): the runs of docs(doc_id, text), lower-cased, those drawn by the hash of document and run without one code point."""
    run = F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(f"({RUN})"), F.lit(1))).alias("run")
    own = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.col("text").alias("text")).select("id", run)
    h = F.crc32(F.concat_ws(":", "id", "run"))
    gone = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), gone), F.substring(F.col("run"), gone + 2, F.length("run")))
    return own.withColumn("h", h).select(F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of that length that occur as often."""
    return runs(docs).where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def entries(words: DataFrame) -> DataFrame:
    """(side, m, low, high, key, word, n): both dictionaries of words(word, n). key is the half that a block shares, reversed in the second."""
    own = words.withColumn("m", F.explode(F.array(F.length("word"), F.length("word") - 1))).where("m > 0")
    half = F.floor(F.col("m") / 2).cast("int")
    first = own.select(F.lit("forward").alias("side"), "m", half.alias("low"), F.col("m").alias("high"), "word", "n")
    second = own.select(F.lit("reversed").alias("side"), "m", F.lit(0).alias("low"), half.alias("high"), "word", "n").where("high > 0")
    return _keyed(first.union(second))


def _keyed(rows: DataFrame) -> DataFrame:
    """What all words of a block agree in: `low` code points at the beginning, m - high at the end."""
    start = F.substring(F.col("word"), F.lit(1), F.col("low"))
    end = F.substring(F.col("word"), F.length("word") - F.col("m") + F.col("high") + 1, F.col("m") - F.col("high"))
    key = F.when(F.col("side") == "forward", F.concat_ws("*", start, F.reverse(end))).otherwise(F.concat_ws("*", F.reverse(end), start))
    return rows.select("side", "m", "low", "high", key.alias("key"), "word", "n")


_BLOCK = ["side", "m", "low", "high", "key"]


def subdivided(rows: DataFrame, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """The entries in blocks of at most `block` words, or of words that agree in all places but one; and tables that can go afterwards. Each
    round writes the entries of the blocks that are still too large, once for each half."""
    small, made = [], []
    rows = written(rows, "spelling-blocks")
    while True:
        made.append(rows)
        large = rows.groupBy(*_BLOCK).agg(F.count("*").alias("size")).where((F.col("size") > block) & (F.col("high") - F.col("low") > 1)).drop("size")
        large = written(large, "spelling-large")
        made.append(large)
        if large.isEmpty():
            return _all([*small, rows]), made
        small.append(rows.join(large, _BLOCK, "left_anti"))
        middle = ((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.array(F.struct("low", middle.alias("high")), F.struct(middle.alias("low"), "high"))
        rows = rows.join(large, _BLOCK, "left_semi").withColumn("half", F.explode(halves)).select("side", "m", "half.low", "half.high", "word", "n")
        rows = written(_keyed(rows), "spelling-blocks")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _near(m: int, low: np.ndarray, high: np.ndarray, letters: np.ndarray, longer: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs (a, b), a of length m and b of m or m + 1, are one edit apart with their common beginning in their block's bounds."""
    x, y = letters[a, :m], letters[b]
    differ = x != y[:, :m]
    some = differ.any(axis=1)
    first = np.where(some, differ.argmax(axis=1), m)
    moved = x != y[:, 1:]
    last = np.where(moved.any(axis=1), m - 1 - moved[:, ::-1].argmax(axis=1), -1)
    one = np.where(longer[b], last < first, differ.sum(axis=1) == 1)
    return one & (first >= low[a]) & ((first < high[a]) | ((high[a] == m) & (first == m)))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the words of each block find in it, blocks of equal m at a time."""

    def solve(m: int, low: list, high: list, words: list, n: list, starts: list) -> Iterator[pa.RecordBatch]:
        width = m + 1
        letters = np.array([w.encode("latin-1") for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)
        order = np.argsort(np.array([w.encode("latin-1") for w in words], f"S{width}"), kind="stable")  # code points in order
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        low, high, n = (np.array(x, np.int64) for x in (low, high, n))
        longer = np.array([len(w) > m for w in words])
        edges = np.array([*starts, len(words)])
        until = np.repeat(edges[1:], np.diff(edges))
        # short words come first in a block, so a pair of a short word and one behind it leaves out pairs of two long ones
        after = np.where(longer, 0, until - np.arange(len(words)) - 1)
        own = np.flatnonzero(after)
        sums = np.cumsum(after[own])
        step = max(1, min(CELLS, BYTES // width))
        cuts = [0, *np.unique(np.searchsorted(sums, np.arange(step, int(sums[-1]) + 1, step), "left") + 1).tolist(), len(own)] if len(own) else []
        pairs = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            if i < j:
                part = own[i:j]
                a = np.repeat(part, after[part])
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after[part]) - after[part], after[part])
                fine = _near(m, low, high, letters, longer, a, b)
                pairs.append((a[fine], b[fine]))
        if not pairs:
            return
        a, b = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
        word, other = np.concatenate((a, b)), np.concatenate((b, a))
        if not len(word):
            return
        order = np.lexsort((rank[other], -n[other], word))
        word, other = word[order], other[order]
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        who, form = word[first], other[first]
        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in who.tolist()], pa.string()), pa.array(np.diff(np.append(first, len(word)))), pa.array(-n[form]), pa.array([words[i] for i in form.tolist()], pa.string())], ["word", "n_near", "minus", "form"])

    def ready(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """Whole blocks, in order; those of a word length together."""
        at = 0
        while at < len(rows):
            m, end, cells, starts = rows[at][1], at, 0, []
            while end < len(rows) and rows[end][1] == m and cells <= CELLS and (end - at) * (m + 1) <= BYTES:
                start = end
                while end < len(rows) and rows[end][:5] == rows[start][:5]:
                    end += 1
                starts.append(start - at)
                cells += (end - start) ** 2 // 2
            part = rows[at:end]
            yield from solve(m, [r[2] for r in part], [r[3] for r in part], [r[5] for r in part], [r[6] for r in part], starts)
            at = end

    held: list[tuple] = []
    for batch in batches:
        held += zip(*(x.to_pylist() for x in batch.columns))
        if len(held) >= 1 << 16:
            last = len(held) - 1
            while last and held[last - 1][:5] == held[last][:5]:
                last -= 1
            yield from ready(held[:last])
            held = held[last:]
            trim()
    yield from ready(held)
    trim()


def near(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, form, form_n) of those of words(word, n) that have near words: how many, and the most frequent."""
    rows, made = subdivided(entries(words), block)
    dealt = rows.repartitionByRange("side", "m", "key", "low", "high").sortWithinPartitions("side", "m", "key", "low", "high", F.length("word"), "word")
    found = written(dealt.select("side", "m", "low", "high", "key", "word", "n").mapInArrow(_verified, FOUND), "spelling-found")
    forget(*made)
    best = F.min(F.struct("minus", "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.minus")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form): the last word that forms lead to. Each round doubles the way that a row has come."""
    now = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "spelling-roots")
    while not now.where("open").isEmpty():
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "spelling-roots")
        forget(now)
        now = new
    return now.select("word", "root")


def variants(docs: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of docs(doc_id, text)."""
    words = written(vocabulary(docs), "spelling-words")
    both = written(words.join(near(words, block), "word", "left"), "spelling-near")
    taken = F.col("form_n") >= 2 * F.col("n")
    own = both.select("word", F.when(taken, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("form_n")).alias("form_n"))
    led = roots(own.where("form is not null"))
    return own.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


DUCKDB_SQL = f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS n FROM r GROUP BY ALL),
h AS (SELECT *, {crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM g),
w AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM w WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS (SELECT x.word, y.word AS other, y.n AS m FROM d x JOIN d y ON x.less = y.less AND x.i = y.i AND x.word <> y.word
UNION SELECT x.word, y.word, y.n FROM d x JOIN v y ON x.less = y.word UNION SELECT y.word, x.word, x.n FROM d x JOIN v y ON x.less = y.word),
b AS (SELECT word, count(*) AS n_near, min({{'minus': -m, 'form': other}}) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.minus >= 2 * v.n THEN best.form END AS form, CASE WHEN -best.minus >= 2 * v.n THEN -best.minus END AS form_n FROM v LEFT JOIN b USING (word)),
t AS (SELECT word, word AS reached, 0 AS k FROM f UNION ALL SELECT t.word, f.form, t.k + 1 FROM t JOIN f ON f.word = t.reached WHERE f.form IS NOT NULL),
z AS (SELECT word, arg_max(reached, k) AS root FROM t GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN z USING (word)"""

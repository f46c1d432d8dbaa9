"""Spelling variants against comparisons of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from veriscreen.llm import spelling


def words_of(rows):
    found = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in spelling.UPPER else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(words):
    near = {w: [x for x in words if abs(len(w) - len(x)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()), key=repr)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, n long, word string, `run.h` int").repartition(4)


def spoilt(rng, word):
    k = rng.randrange(len(word) + 1)
    return rng.choice([word[:k] + rng.choice("abcé") + word[k:], word[:k] + rng.choice("abcé") + word[k + 1 :], word[:k] + word[k + 1 :]])


def corpus(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(3, 12))) for _ in range(60)] + ["straße", "ÉTUDEs", "naïveté", "prefixing" * 5]
    for _ in range(4):
        base += [spoilt(rng, w) for w in rng.sample(base, len(base) // 2) if w]
    for i in range(n):
        yield i, rng.choice([" ", "-", "\n", "1", "×"]).join(rng.choice([str, str.upper, str.capitalize])(rng.choice(base[: rng.randint(1, len(base))])) for _ in range(60))


@pytest.mark.parametrize("block", [spelling.BLOCK, 2])
def test_variants(spark, block):
    rows = [*corpus(1, 150), (None, "nullnull nullnull nullnull"), (900, None), (901, ""), (902, "1 2 3"), (903, ("x" * 70_000 + " ") * 3), (904, ("x" * 69_999 + " ") * 7), (7, "repeated repeated"), (7, "repeated")]
    got = sorted(map(tuple, spelling.variants(documents(spark, rows), block=block).collect()), key=repr)
    want = brute(words_of(rows))
    assert got == want
    assert any(r[1] and r[2] != r[1] for r in got)


def test_blocks_of_a_hot_beginning_end_small(spark):
    """A third of all words share one beginning: they are subdivided, and no pair is compared twice or lost."""
    rng = random.Random(4)
    words = {"gemeinsam" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9))): rng.randint(3, 50) for _ in range(1500)}
    for w in rng.sample(sorted(words), 700):
        words[spoilt(rng, w)] = rng.randint(3, 9)
    rows = spark.createDataFrame([(w, n) for w, n in words.items()], "word string, n long")
    blocks, made = spelling.subdivided(spelling.entries(rows), 8)
    assert blocks.groupBy(*spelling._BLOCK).count().where("`count` > 8 and high - low > 1").isEmpty()
    spelling.forget(*made)
    got = {r.word: (r.n_near, r.form, r.form_n) for r in spelling.near(rows, 8).collect()}
    near = {w: [x for x in words if one_edit(w, x)] for w in words if w[:3] == "gem"}
    for w, own in near.items():
        best = min(own, key=lambda x: (-words[x], x), default=None)
        assert got.get(w, (0, None, None)) == (len(own), best, words.get(best))


def test_long_chains_of_forms(spark):
    """Each word's form is the next one: roots are found in a number of rounds that grows with the logarithm."""
    words = [("a" * k, 3 * 2**k) for k in range(5, 40)]
    forms = spark.createDataFrame([(a[0], b[0]) for a, b in zip(words, words[1:])], "word string, form string")
    assert {tuple(r) for r in spelling.roots(forms).collect()} == {(w, "a" * 39) for w, _ in words[:-1]}


def test_empty_table(spark):
    assert spelling.variants(documents(spark, [])).collect() == []
    assert spelling.variants(documents(spark, [(1, None)])).collect() == []

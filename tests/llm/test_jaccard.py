import itertools
import random
import re

import numpy as np
import pytest

from veriscreen.llm import jaccard

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    """{row number: (n_shingles, component)} with the smallest id of each component."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(rows[i][0], len(sets[i]), least.get(find(i))) for i in range(len(rows))]


def family(seed, copies, edits, words=60):
    rng = random.Random(seed)
    base = [f"w{seed}x{rng.randrange(10**6)}" for _ in range(words)]
    for _ in range(copies):
        own = list(base)
        for k in rng.sample(range(words), rng.randrange(edits + 1)):
            own[k] = f"e{rng.randrange(10**6)}"
        yield " ".join(own)


def check(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((tuple(r) for r in jaccard.join(docs).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_numbers_of_links(spark):
    """Links within a component count, those of equal texts and of lists of two included."""
    texts = [t for k, (copies, edits) in enumerate([(30, 5), (20, 8), (2, 1)]) for t in family(70 + k, copies, edits)]
    rows = [(k, t) for k, t in enumerate(texts + texts[:6] + texts[:2] + ["", None, "a b", "A b", "alone here"])] + [(None, texts[0]), (3, texts[9])]
    sets = [shingles(t) for _, t in rows]
    want = [sum(4 * len(x & y) >= 3 * len(x | y) for j, y in enumerate(sets) if j != i and x) for i, x in enumerate(sets)]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), count_links=True).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((*a, n) for a, n in zip(brute(rows), want)), key=repr)
    assert max(want) > 10


@pytest.mark.parametrize("seed", [1, 2])
def test_families_of_near_copies(spark, seed):
    """Many members are far from the pivots of their lists, so links across components have to be found by queries."""
    texts = [t for k, (copies, edits) in enumerate([(40, 5), (30, 3), (25, 8), (3, 2)]) for t in family(10 * seed + k, copies, edits)]
    texts += texts[:5] + [" ".join(f"u{seed}{i}{j}" for j in range(30)) for i in range(10)]
    random.Random(seed).shuffle(texts)
    check(spark, list(enumerate(texts)))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  B"), (6, "a b c d e"), (7, "a b c d e"), (7, "a b c d e"), (8, "a b c d f"), (None, "a b c d f"), (None, "x y z"), (9, "word " * 5000)]
    check(spark, rows)


def test_empty_table_and_clashing_columns(spark):
    assert jaccard.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "k", 2), (2, "a b c d e f", 6, "l", 3)], "doc_id long, text string, n_shingles int, key string, row int")
    assert sorted(map(tuple, jaccard.join(docs).collect())) == [(1, 2, 1), (2, 2, 1)]
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(1, "a b c d e f", 5, "k", 2)]


def test_keep_first_keeps_one_of_each_group_and_rows_without_words(spark):
    texts = list(family(5, 20, 4)) + ["other words that stand all alone here"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100, None), (100, None), (101, ""), (0, texts[0]), (None, texts[-1])]
    kept = [tuple(r) for r in jaccard.keep_first(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()]
    groups = {c for i, n, c in brute(rows) if n}
    assert sorted((i for i, t in kept if t), key=str) == sorted(groups, key=str)
    assert sum(not t for _, t in kept) == 3


def test_prefixes_of_linked_sets_share_enough():
    rng = np.random.default_rng(3)
    for _ in range(300):
        n = int(rng.integers(1, 60))
        freq = np.sort(rng.integers(1, 50, n))
        size, matches = jaccard.prefix(freq, 3, 4)
        least = -(-3 * n // 4)
        assert size == n - least + matches <= n and 1 <= matches <= jaccard.MAX_MATCHES


def test_large_families_meet_in_many_tiles(spark, monkeypatch):
    """Families above TILE are cut into bands and parts; texts of more shingles than a row of a set holds; many classes of a
    block with one shingle."""
    monkeypatch.setattr(jaccard, "TILE", 400)
    texts = list(family(31, 90, 9)) + list(family(32, 70, 3, words=40)) + list(family(33, 4, 3, words=1500)) + [" ".join(f"q{j}" for j in range(n)) for n in range(60, 90)]
    rows = list(enumerate(texts))
    sets = [shingles(t) for t in texts]
    want = [sum(4 * len(x & y) >= 3 * len(x | y) for j, y in enumerate(sets) if j != i) for i, x in enumerate(sets)]
    for parts in (1, 3):
        got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), count_links=True).collect()
        assert sorted(map(tuple, got)) == sorted((*a, n) for a, n in zip(brute(rows), want))


def test_work_columns_of_the_user_keep_their_values(spark):
    names = ["_row", "row", "nth", "all", "worded", "_nth", "key", "family"]
    docs = spark.createDataFrame([(k, f"a b c d e f g {k // 2}", *(f"{n}{k}" for n in names)) for k in range(6)] + [(9, None, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    assert sorted(map(tuple, jaccard.keep_first(docs).collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id in (0, 2, 4, 9))


@pytest.mark.parametrize("ahead", [0, 7])
def test_incidence_counts_what_sets_share(ahead):
    rng = np.random.default_rng(ahead)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 80)).astype(np.uint64)) for _ in range(200)]
    sets = [np.arange(k, 60 + k, dtype=np.uint64) for k in range(5)] + sets + [np.arange(k, 60 + k, dtype=np.uint64) for k in range(9)]
    n = np.array([len(x) for x in sets])
    got = {(i, j) for i, found in jaccard.linked(sets, n, np.ones(len(sets), int), n, 3, 4, ahead) for j in found.tolist()}
    want = {(i, j) for i in range(ahead or 1, len(sets)) for j in range(ahead or i) if 4 * len(np.intersect1d(sets[i], sets[j])) >= 3 * len(np.union1d(sets[i], sets[j]))}
    assert got == want and want

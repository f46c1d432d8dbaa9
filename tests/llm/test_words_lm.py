import random
import re

import numpy as np
import pytest

from tests.llm.lm_brute import brute
from veriscreen.llm import lm, words

TEXTS = [None, "", " ", "a", "A b\tc\n\x0b d\x0c\re ", "é\xa0x y\x85z\x1c", "日本 語", "x" * 3000, "tail ", " lead"]


def test_words_are_cut_at_six_bytes_only():
    codes, counts = words.word_codes(TEXTS, False)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in TEXTS]
    assert counts.tolist() == [len(w) for w in want] == [len(words.split_words(t)) for t in TEXTS]
    flat = [w for own in want for w in own]
    assert len({*codes.tolist()}) == len(set(flat)) and len(codes) == len(flat)
    lower, _ = words.word_codes(["AbC É", "aBc É", "abc é"], True)
    assert lower[0] == lower[2] == lower[4] and lower[1] == lower[3] != lower[5]


def test_chunks_do_not_change_codes():
    texts = [" ".join(f"w{i % 97}" for i in range(n)) for n in (1, 50_000, 3, 100_000)]
    codes, counts = words.word_codes(texts, True)
    one = [words.word_codes([t], True)[0] for t in texts]
    assert np.array_equal(codes, np.concatenate(one)) and counts.tolist() == [len(x) for x in one]


@pytest.mark.parametrize("order", [2, 3])
def test_scores_match_the_model(spark, order):
    rng = random.Random(order)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(80)]
    rows += [(None, "w1 W2"), (200, None), (201, ""), (3, rows[3][1]), (3, rows[3][1]), (202, "new words " * 700)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double").repartition(3)
    got = sorted((tuple(r) for r in lm.score(docs, order=order).collect()), key=repr)
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute(rows, order))), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_seen_words_gain_over_unigrams(spark):
    """Held-out copies of training texts are likelier under the model than under its unigrams."""
    rng = random.Random(1)
    rows = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(50))) for i in range(40)]
    rows += [(1000 + i, t) for i, t in rows]
    held = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert held and all(r.score > r.base_score for r in held if r.n_known == r.n_tokens)


def test_the_model_backs_off_from_two_words(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randrange(12)}" for _ in range(40))) for i in range(60)]
    got = sorted((tuple(r) for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = sorted(((i, *w) for (i, _), w in zip(rows, brute(rows, 3))), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_empty_table(spark):
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.score for r in lm.score(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()] == [0.0]


def test_a_text_longer_than_a_block_and_extra_columns(spark):
    """One text is nearly the whole table; other columns, of clashing names too, are ignored."""
    rng = random.Random(6)
    rows = [(7, " ".join(f"w{rng.randrange(300)}" for _ in range(60_000)))] + [(k, f"w{k} w{k + 1} w{k}") for k in range(20)]
    docs = spark.createDataFrame([(i, t, 2.0, True) for i, t in rows], "doc_id long, text string, n_tokens double, held_out boolean").coalesce(1)
    got = sorted(tuple(r) for r in lm.score(docs).collect())
    want = sorted((i, *w) for (i, _), w in zip(rows, brute(rows, 3)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


def test_messages_grow_with_the_input(spark):
    """A word in every block reaches its bucket once a block, and twice the input makes about twice the codes."""
    from veriscreen.llm import exchange

    sent = {}
    for n in (2000, 4000):
        docs = spark.createDataFrame([(k, f"common words here u{k} v{k} x{k} y{k}") for k in range(n)], "doc_id long, text string").repartition(4)
        blocks = exchange.Blocks(docs, 2)

        def ask(block, rows):
            own = lm._Block(rows, 2, 10)
            return lm._asked([(own.grams[1].codes, own.grams[1].counts)], 8)

        messages = blocks.each(lambda x: [(bucket, len(exchange.unpack(payload)[1])) for bucket, payload in ask(x[0], x[1])]).collect()
        sent[n] = sum(size for _, size in messages)
        assert len(messages) <= 8 * 8 and sent[n] <= 4 * n + 8 * 5
    assert sent[4000] < 2.1 * sent[2000]


def test_ranked_is_unique_with_places():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 1000, 70_000):
        codes = words.mix(rng.integers(0, max(1, n // 3), n).astype(np.uint64))
        unique, which = words.ranked(codes)
        want, places = np.unique(codes, return_inverse=True)
        assert np.array_equal(unique, want) and np.array_equal(which, places)


def test_codes_that_share_their_upper_bits_are_told_apart():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 4_000_000).astype(np.uint64)
    codes[17], codes[3_000_000] = codes[5] ^ np.uint64(1), codes[5] ^ np.uint64(1 << 21)  # the upper 42 bits are equal
    codes[2_500_000:2_500_003] = codes[5]
    for own in (codes, codes[:1000], np.repeat(np.arange(70, dtype=np.uint64), 30)[::-1].copy(), codes[:1], codes[:0]):
        found, which = words.ranked(own)
        assert (found == np.unique(own)).all() and (found[which] == own).all()


def test_word_codes_travel_whole():
    """Two codes that share a bucket and 40 bits are two words."""
    from veriscreen.llm import exchange, lm

    codes = np.array([1 << 40, (1 << 40) + 1, (1 << 40) + 2], np.uint64)
    (bucket, payload), = lm._asked([(codes, np.array([1, 2, 3]))], 8, words=True)
    assert (exchange.widened(*exchange.unpack(payload)[:2]) == codes).all()
    (_, (_, answer)), = lm._totals([1])(bucket, [(0, payload)])
    (owner, totals), = lm._told([(0, answer)], [1])
    assert owner.tolist() == [True] * 3 and totals.tolist() == [1, 2, 3]

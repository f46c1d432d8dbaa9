"""Embeddings, mixing, token files."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from veriscreen.llm import embeddings, mixing, token_files
from veriscreen.llm.queries import tokenizer_path

# ---- embeddings


def brute_links(rows, cosine=0.9):
    good = [i is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for i, v in rows]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if good[a] and good[b] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[k][1], float) for k in (a, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= cosine:
                    n[a], n[b] = n[a] + 1, n[b] + 1
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if good[k]:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, n[k], (least[find(k)] if good[k] else i), i is not None and (least[find(k)] if good[k] else i) == i) for k, (i, _) in enumerate(rows)]


def clusters(seed, dim=16):
    rng = np.random.default_rng(seed)
    for size, spread in [(1, 0), (2, 0.1), (30, 0.12), (25, 0.2), (12, 0.02), (40, 1.0)]:
        centre = rng.normal(size=dim)
        for _ in range(size):
            yield (centre + spread * np.linalg.norm(centre) / math.sqrt(dim) * rng.normal(size=dim)).astype(np.float32).tolist()


@pytest.mark.parametrize("tile", [1024, 8])
def test_near_duplicates(spark, tile):
    rows = list(enumerate(clusters(1)))
    rows += [(1000 + k, rows[5][1]) for k in range(6)] + [(7, rows[5][1]), (7, rows[7][1])]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [nan] + [1.0] * 15), (2004, [inf] * 16), (2005, [1.0, None]), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (None, rows[5][1]), (2008, [1e-38] * 16), (2009, [3.0] * 16)]
    random.Random(1).shuffle(rows)
    vectors = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, n_links int").repartition(3)
    got = sorted((tuple(r) for r in embeddings.near_duplicates(vectors, miss=1e-6, tile=tile).collect()), key=repr)
    want = brute_links([(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    assert got == sorted(want, key=repr)


def test_embeddings_of_empty_tables_and_doubles(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    got = embeddings.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_tables_are_enough_for_long_vectors():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2, 800, 1024))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (y * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(0.19) * y / np.linalg.norm(y, axis=1, keepdims=True)
    k, tables = embeddings.sizes_for(200_000, 1024)
    assert k == 2
    a, b = (embeddings.probes_of(z, tables, k, embeddings.PROBES) for z in (x, y))
    met = ((a == b[:, :, :1]).any(axis=2) | (b == a[:, :, :1]).any(axis=2)).any(axis=1)
    assert (~met).sum() <= 2
    assert embeddings.sizes_for(200_000, 64) == (2, 9) and embeddings.sizes_for(10**7, 10**4)[1] > embeddings.sizes_for(10**7, 4096)[1]


def test_hadamard_keeps_lengths_and_hashing_finds_close_pairs():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 64))
    assert np.allclose(np.linalg.norm(embeddings.fwht(x), axis=1), np.linalg.norm(x, axis=1))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * z / np.linalg.norm(z, axis=1, keepdims=True)
    k, tables = embeddings.sizes_for(50_000, 64)
    p, q = (embeddings.probes_of(v, tables, k, embeddings.PROBES) for v in (x, y))
    met = ((p[:, :, :1] == q).any(2) | (q[:, :, :1] == p).any(2)).any(1)
    assert met.mean() > 0.99


# ---- mixing


def mixture(spark, rows, **options):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, _pass string"), **options)


def corpus(sizes):
    out = []
    for k, (source, docs) in enumerate(sizes.items()):
        out += [(1000 * k + i, "w " * (i % 7 + 1), source, "x") for i in range(docs)]
    return out


def test_default_budget_keeps_everything_and_meets_the_limit(spark):
    rows = corpus({"a": 400, "b": 40, "c": 10, None: 5}) + [(None, None, "a", "x"), (9, "", "b", "x")]
    got = mixture(spark, rows, max_repeats=4.0).collect()
    times = {}
    for r in got:
        times.setdefault((r.doc_id, r.text, r.source), []).append(r._pass)
    assert set(times) == {(i, t, s) for i, t, s, _ in rows} and all(sorted(p) == list(range(len(p))) for p in times.values())
    tokens = lambda rows: {s: sum(len((r[1] or "").split()) for r in rows if r[2] == s) for s in ("a", "b", "c", None)}
    before, after = tokens(rows), tokens([(r.doc_id, r.text, r.source) for r in got])
    passes = {s: after[s] / before[s] for s in before}
    assert passes["a"] == 1 and 3.5 < passes[None] <= 4.001 and 1 < passes["b"] < passes["c"] < passes[None]


def test_budget_and_entropy(spark):
    rows = corpus({"a": 300, "b": 60})
    got = mixture(spark, rows, budget=200, max_repeats=None).collect()
    a, take = mixing.plan({"a": 1196, "b": 234}, budget=200, max_repeats=None)
    assert a == 0 and take == {"a": 100, "b": 100}
    for s in "ab":
        own = sum(r._tokens for r in got if r.source == s)
        assert 100 - 7 <= own <= 100
    sizes = [1000, 100, 10]
    for target in (0.3, 0.5, 0.9):
        e = mixing.exponent(sizes, max_repeats=None, entropy=target)
        w = np.array(sizes, float) ** e
        w /= w.sum()
        assert -(w * np.log(w)).sum() <= target * math.log(3) + 1e-9 and abs(-(w * np.log(w)).sum() - target * math.log(3)) < 1e-6 and (e > 1) == (target < 0.32)
    assert mixing.exponent([5]) == 1.0 and mixing.exponent([8, 2], max_repeats=4.0) == 0.0


def test_mixing_repeats_the_same_and_handles_empty_tables(spark):
    rows = corpus({"a": 50, "b": 20})
    one, two = (sorted(map(repr, mixture(spark, rows).collect())) for _ in range(2))
    assert one == two != sorted(map(repr, mixture(spark, rows, seed=1).collect()))
    assert mixture(spark, []).count() == 0
    assert mixture(spark, [(1, None, "a", "x"), (2, "", None, "x")]).count() == 2


# ---- token files


NASTY = ["", " ", "a", " a", "a ", "a  b", "a \n b", "a\nb c", "it's  'tis 'll", "a <|endoftext|> b", "\n", "foo\n bar", "12 34,56", "tab\t x", "日本 語 。", "a 's b", None, "a\n\n\nb c\nd", "x\x85 y", "q  z", "\x1c a", "a\x1c b", "word " * 20000]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def test_encoder_gives_the_librarys_ids(tokenizer):
    encoder = token_files.Encoder(tokenizer_path())
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choices(["a", "Bc", " ", " ", "\n", "é", "1", ".", "'s", " ", "日"], k=40)) for _ in range(300)]
    for _ in range(2):  # the second time pieces are known
        ids, n = encoder.encode(pa.array(texts), 2)
        at = 0
        for t, k in zip(texts, n.tolist()):
            assert ids[at : at + k].tolist() == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
            at += k
        assert at == len(ids)


def test_shards_give_any_id():
    rng = np.random.default_rng(1)
    ids = np.concatenate((rng.integers(0, 1 << rng.integers(1, 31, 5000)), [0, 255, 256, 65535, 65536, (1 << 32) - 1])).astype(np.uint32)
    shard = token_files.Shard.from_bytes(token_files.Shard.encode([3, None], ids, np.array([0, 2000, len(ids)])).to_bytes())
    assert len(shard) == len(ids) and [shard[int(i)] for i in range(0, len(ids), 7)] == ids[::7].tolist() and shard[len(ids) - 1] == ids[-1]
    for a, b in [(0, len(ids)), (17, 17), (511, 514), (4000, 5006)]:
        assert np.array_equal(shard.slice(a, b), ids[a:b])
    with pytest.raises(IndexError):
        shard[len(ids)]
    with pytest.raises(ValueError):
        token_files.Shard.from_bytes(b"x" * 100)


@pytest.mark.parametrize("shard_tokens", [50, 1 << 22])
def test_round_trip(spark, tokenizer, shard_tokens):
    rows = [(100 - i, t, 5) for i, t in enumerate(NASTY)] + [(90, "again", 5), (None, "no id", 5), (10**12, "big id", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(4)
    folder = token_files.write_token_files(docs, tokenizer_path(), shard_tokens=shard_tokens)
    got = token_files.read_token_files(spark, folder).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    got.sort(key=lambda r: r.start)
    at = 0
    for (i, t, _), r in zip(order, got, strict=True):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, list(r.ids)) == (i, at, len(ids), ids)
        at += len(ids)
    digests = sorted(token_files.digest_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert [(d.doc_id, d.start, d.n_tokens, d.ids_crc32) for d in digests] == [(r.doc_id, r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got]


def test_token_files_of_an_empty_table(spark):
    folder = token_files.write_token_files(spark.createDataFrame([], "doc_id long, text string"), tokenizer_path())
    assert token_files.digest_token_files(spark, folder).count() == 0


def test_blocks_do_not_depend_on_size(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "w " * (i % 4), "ab"[i % 5 == 0]) for i in range(3000)], "doc_id long, text string, source string").repartition(3)
    take = lambda: sorted(tuple(r) for r in mixing.mix(docs, budget=7000).select("doc_id", "source", "_pass", "_block", "_place").collect())
    want = take()
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 1)
    assert mixing.block_digits(2400) == 3 and take() == want
    assert {len(r[3]) for r in want} == {2} and len(want) > 3000


def test_a_token_costs_a_page(spark, tokenizer):
    """Reading one id touches a small part of the files, by the file system's count of bytes."""
    rng = random.Random(3)
    rows = [(k, " ".join(f"w{rng.randrange(9999)}" for _ in range(300))) for k in range(2000)] + [(None, f"no id {k}") for k in range(200)]
    folder = token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tokenizer_path(), shard_tokens=4000)
    all_ids = np.concatenate([r.ids for r in sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)])
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.FileSystem
    read = lambda: sum(x.getBytesRead() for x in files.getAllStatistics() if x.getScheme() == "file")
    size = sum(f.stat().st_size for f in __import__("pathlib").Path(folder.removeprefix("file:")).glob("*.parquet"))
    for place in (0, 12345, len(all_ids) - 1):
        before = read()
        assert token_files.tokens_at(spark, folder, place).tolist() == [all_ids[place]]
        assert 0 < read() - before < size / 4, (read() - before, size)
    assert token_files.tokens_at(spark, folder, 3990, 12010).tolist() == all_ids[3990:12010].tolist()
    with pytest.raises(IndexError):
        token_files.tokens_at(spark, folder, len(all_ids))


def test_null_and_repeated_ids_across_shards(spark, tokenizer):
    """Ids that many rows have, null ones among them, fill several shards and partitions in the order of texts; columns of the
    results' names are ignored."""
    rng = random.Random(8)
    text = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 30)))
    rows = [(i, text(), [9], 1) for i in [None] * 300 + [5] * 300 + list(range(50))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, start int").repartition(6)
    folder = token_files.write_token_files(docs, tokenizer_path(), shard_tokens=500)
    got = sorted(token_files.read_token_files(spark, folder).collect(), key=lambda r: r.start)
    want = sorted(((i, t) for i, t, _, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert [list(r.ids) for r in got] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for _, t in want]
    assert spark.read.parquet(folder).count() > 8


def test_mixing_keeps_columns_of_any_name(spark):
    names = ["_source", "_whole", "_left", "_sum", "used", "fits", "source_", "tokens", "pass", "block", "place", "room", "part", "first", "n", "all", "whole"]
    rows = [(k, "w " * (k % 5 + 1), "ab"[k % 7 == 0], *(f"{n}{k}" for n in names)) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string" + "".join(f", `{n}` string" for n in names))
    got = mixing.mix(docs).collect()
    assert len(got) > 60 and all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert mixing.mix(docs).columns == [*docs.columns, "_tokens", "_pass", "_block", "_place"]


def test_mixing_to_an_entropy_needs_no_list_of_sources(spark):
    """Sums over sources alone give the same weights as all sizes do."""
    rows = [(k, "w " * 10, f"s{min(k // 40, 5)}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = {f"s{j}": 400 if j < 5 else 2000 for j in range(6)}
    a, take = mixing.plan(sizes, budget=2000, max_repeats=None, entropy=0.9)
    got = mixing.mix(docs, budget=2000, max_repeats=None, entropy=0.9).groupBy("source").sum("_tokens").collect()
    assert a > 0 and all(take[r[0]] - 10 < r[1] <= take[r[0]] for r in got)


def test_runs_of_equal_rows_are_written_as_often_as_they_stand(spark, tokenizer):
    rows = [(1, "a b")] * 3 + [(2, None)] * 2 + [(None, "x")] * 4 + [(1, "a b"), (3, ""), (3, ""), (3, "c"), (None, None), (None, None), (4, "long " * 3000)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    read = lambda folder: sorted(map(tuple, token_files.digest_token_files(spark, folder).collect()), key=lambda r: r[1])
    one, two = (read(token_files.write_token_files(docs, tokenizer_path(), shard_tokens=2000, runs=x)) for x in (False, True))
    assert one == two and len(one) == len(rows)

"""Each stage of the pipeline against a brute-force one, on a small fixture."""

import random

import pytest

import corpus_pipeline as pipeline
from tests.llm.test_jaccard import brute, family
from tests.llm.test_text_ops import shingles
from veriscreen.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents with copies, near copies, toxic words and benchmark passages; labels; benchmark."""
    rng, d = random.Random(8), str(tmp_path_factory.mktemp("tables"))
    items = [(k, " ".join(f"b{k}x{j}" for j in range(20))) for k in range(5)]
    texts = [t for k in range(3) for t in family(70 + k, 6, 3)] + [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(150)]
    texts = [f"{t} {items[k % 5][1]} tail" if k % 11 == 0 else t for k, t in enumerate(texts)]
    bad = {k for k in range(len(texts)) if k % 4 == 1}
    texts = [f"{t} scoundrel" if k in bad else t for k, t in enumerate(texts)] + [None, "", texts[0]]
    rows = [(k, t, "en", f"s{k % 7 % 3}", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in bad)) for k in range(len(texts) - 3)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def test_stages(spark, tables, tmp_path):
    d, rows, items = tables
    assert [name for name, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), rows
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = sorted((tuple(r) for r in docs.collect()), key=repr)
        if name != "token_files":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name == "toxicity":
            want = [r for r in kept if "scoundrel" not in (r[1] or "")]
        elif name == "near_duplicates":
            groups = brute([r[:2] for r in kept])
            want = [r for r, (i, n, c) in zip(kept, groups) if not n or i == c]
        elif name == "decontamination":
            dirty = lambda t: any(4 * len(shingles(t) & shingles(x)) >= 3 * len(shingles(x)) for _, x in items)
            want = [r for r in kept if not dirty(r[1])]
        elif name == "mixing":
            sizes = {s: sum(len((r[1] or "").split()) for r in kept if r[3] == s) for s in {r[3] for r in kept}}
            _, take = mixing.plan(sizes)
            assert set(got) == set(kept)
            for s, n in sizes.items():
                own = sum(len((r[1] or "").split()) for r in got if r[3] == s)
                assert take[s] - 80 <= own <= take[s] and own >= n
            want = got
        else:
            assert [r[0] for r in sorted(got, key=lambda r: r[1])] == sorted(r[0] for r in kept)
            assert sorted(got, key=lambda r: r[1])[-1][1] + sorted(got, key=lambda r: r[1])[-1][2] == sum(r[2] for r in got)
            want = got
        assert got == sorted(want, key=repr), name
        kept = got


def test_run_gives_the_last_stages_rows(spark, tables):
    d, _, _ = tables
    assert pipeline.run(spark, d).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_stages_pass_empty_tables_nulls_and_extra_columns(spark, tables):
    d, _, _ = tables
    odd = spark.createDataFrame([(None, None, None, None, None, "k"), (5, "some words that are clean here", "en", None, 3, "l"), (5, "some words that are clean here", "en", None, 3, "l")], DOCS + ", _score string")
    for name, stage in pipeline.STAGES:
        assert stage(spark, odd.limit(0), d).count() == 0
        out = stage(spark, odd, d)
        if name != "token_files":
            assert out.columns == odd.columns
        n = {"near_duplicates": 2, "mixing": None}.get(name, 3)
        assert n is None or out.count() == n, name




def test_work_columns_of_the_user_keep_their_values(spark, tables):
    """Names that stages might use for themselves, as text columns: values stay with their rows."""
    d, rows, _ = tables
    names = "_score _row _nth _source _whole _left _sum used fits _pass _block _place _tokens score row nth all source_ tokens pass block place room part first sum key worded".split()
    docs = spark.createDataFrame([(*r, *(f"{n} of {r[0]}" for n in names)) for r in rows], DOCS + "".join(f", `{n}` string" for n in names))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[n] == f"{n} of {r.doc_id}" for r in got for n in names), name

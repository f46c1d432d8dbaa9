"""Work that must not repeat: texts are cut once, files are hashed where they are read."""

import json

import pytest

from pyspark.sql import functions as F

from veriscreen import cli
from veriscreen.functions import text
from veriscreen.operators import audit, corpus
from veriscreen.sources import files


def test_texts_are_cut_once_and_windows_stay_in_order(spark, tmp_path, monkeypatch):
    made = [{"pmid": str(k), "title": f"T{k}", "abstract": " ".join(f"w{j}" for j in range(k % 40 + 1)), "label": 1, "data_status": "reconstruction"} for k in range(300)]
    (tmp_path / "raw.jsonl").write_text("".join(json.dumps(r) + "\n" for r in made))
    seen, plain = spark.sparkContext.accumulator(0), text.tokens

    def counted(x):
        seen.add(1)
        return x

    monkeypatch.setattr(text, "tokens", lambda c: plain(F.udf(counted, "string")(c)))
    cli.main(["preprocess", "--input", str(tmp_path / "raw.jsonl"), "--output", str(tmp_path / "out"), "--max-length", "12", "--overlap", "2", "--status", "reconstruction"], spark)
    assert seen.value == 300  # several times that before
    rows = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert [(r["pmid"], r["chunk_index"]) for r in rows] == sorted((r["pmid"], r["chunk_index"]) for r in rows) and len({r["pmid"] for r in rows}) == 300
    assert json.loads((tmp_path / "out.manifest.json").read_text())["chunks"] == len(rows)


def test_lines_meet_their_numbers_and_hashes_without_a_shuffle(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"a\nb\n" * 5000)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    plan = files.fingerprints(spark, [str(tmp_path / "x")])._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in plan and "Sort" not in plan and spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert "SortMergeJoin" not in files.numbered_lines(spark, [str(tmp_path / "x")])._jdf.queryExecution().executedPlan().toString()


def _windows(spark, more=()):
    rows = [("f", k, f"p{k // 2}", k % 2, 1, 1, [2, k, 3], [1, 1, 1], [0, 0, 0]) for k in range(40)]
    return spark.createDataFrame([*rows, *more], "path string, line long, pmid string, chunk_index int, label int, original_label int, input_ids array<int>, attention_mask array<int>, token_type_ids array<int>")


def test_windows_that_occur_once_are_not_shuffled(spark):
    plan = corpus.validated(_windows(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    twice = _windows(spark, [("g", 7, "p3", 1, 1, 0, [2, 7, 3], [1, 1, 1], [0, 0, 0])])
    got, want = corpus.validated(twice), corpus.merged(twice)
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("size(sources) = 2").count() == 1
    with pytest.raises(ValueError, match="conflicting payloads: p3"):
        corpus.validated(_windows(spark, [("g", 7, "p3", 1, 1, 0, [2, 8, 3], [1, 1, 1], [0, 0, 0])]))
    with pytest.raises(ValueError, match="g:9: mask_values"):
        corpus.validated(_windows(spark, [("g", 9, "q", 0, 1, 1, [2, 8, 3], [1, None, 2], [0, 0, 0])]))


def test_windows_are_scored_once(spark, tmp_path, monkeypatch):
    row = lambda k, y: json.dumps({"pmid": f"{y}{k}", "chunk_index": 0, "label": y, "input_ids": [2, 5, 3], "attention_mask": [1] * 3, "token_type_ids": [0] * 3}) + "\n"
    for y in (0, 1):
        (tmp_path / f"{y}").write_text("".join(row(k, y) for k in range(50)))
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return 0.25

    monkeypatch.setattr(cli.scoring, "surrogate", lambda pmid, index: F.udf(counted, "double")(pmid))
    cli.main(["evaluate", "--positive", str(tmp_path / "1"), "--negative", str(tmp_path / "0"), "--threshold", "0.5", "--output-dir", str(tmp_path / "out")], spark)
    assert seen.value == 100  # several times that before
    assert json.loads((tmp_path / "out/external_results.json").read_text())["metrics"]["n_articles"] == 100


def test_windows_are_written_once_and_training_keeps_ids_alone(spark, tmp_path, monkeypatch):
    """Where no window repeats, checked windows are the table of parsed lines; the model's parts carry no masks."""
    row = lambda k, y: json.dumps({"pmid": f" {y}{k} ", "chunk_index": 0, "label": y, "input_ids": [2, 5 + y, 3], "attention_mask": [1] * 3, "token_type_ids": [0] * 3}) + "\n"
    for y in (0, 1):
        (tmp_path / f"{y}").write_text("".join(row(k, y) for k in range(20)))
    made = {}
    for module in (cli, corpus, files):
        monkeypatch.setattr(module, "materialized", lambda df, name, plain=module.materialized: (made.setdefault(name, df.columns), plain(df, name))[1])
    cli.main(["train", "--positive", str(tmp_path / "1"), "--negative", str(tmp_path / "0"), "--output-dir", str(tmp_path / "out"), "--epochs", "1", "--features", "8", "--train-batch-size", "4"], spark)
    assert "windows" not in made and not {"attention_mask", "token_type_ids"} & set(made["parts"]) and "input_ids" in made["lines"]  # a copy with all arrays, twice, before
    articles = json.loads((tmp_path / "out/split_manifest.json").read_text())["articles"]
    assert sorted(x["pmid"] for x in articles) == sorted(f"{y}{k}" for y in (0, 1) for k in range(20))
    assert json.loads((tmp_path / "out/internal_results.json").read_text())["metrics"]["accuracy"] == 1.0


def test_fitted_training_cuts_texts_once(spark, monkeypatch):
    from veriscreen.plans import queries as Q
    from veriscreen.plans import training_queries

    seen, plain = spark.sparkContext.accumulator(0), text.tokens

    def counted(x):
        seen.add(1)
        return x

    monkeypatch.setattr(text, "tokens", lambda c: plain(F.udf(counted, "string")(c)))
    training_queries.command_train_fitted(spark, "/root/testdata/sf0.001").collect()
    assert seen.value == Q.labelled(spark, "/root/testdata/sf0.001").count()  # several times that before


def test_analysis_draws_once_for_groups_and_pairs(spark, tmp_path, monkeypatch):
    row = lambda k, g: json.dumps({"pmid": f"{g}{k}", "label": k % 2, "n_chunks": 1, "mean_positive_probability": (k * 7 + g) % 10 / 10, "prediction": int((k * 7 + g) % 10 >= 5), "threshold": 0.5, "sources": ["a"]}) + "\n"
    for g in (0, 1):
        (tmp_path / f"{g}").write_text("".join(row(k, g) for k in range(30)))
    drawn, plain = [], audit.resampled
    monkeypatch.setattr(audit, "resampled", lambda values, by, value, *rest, **more: (drawn.append(value), plain(values, by, value, *rest, **more))[1])
    cli.main(["analyze", "--group", f"a={tmp_path / '0'}", "--group", f"b={tmp_path / '1'}", "--output-dir", str(tmp_path / "out"), "--bootstrap-replicates", "100"], spark)
    assert sorted(drawn) == ["mean_positive_probability", "prediction"]  # twice each before
    found = json.loads((tmp_path / "out/analysis.json").read_text())
    own = files.predictions(spark, [str(tmp_path / "0")]).withColumn("group", F.lit("a")).union(files.predictions(spark, [str(tmp_path / "1")]).withColumn("group", F.lit("b")))
    for c, low, high in (("mean_positive_probability", "low", "high"), ("prediction", "rate_low", "rate_high")):
        want = audit.bootstrap_differences(own, "group", c, 100, groups=["a", "b"]).first()
        assert (found["pairwise_comparisons"][0][low], found["pairwise_comparisons"][0][high]) == pytest.approx((want.low, want.high))
        groups = {r.group: r for r in audit.bootstrap(own, "group", c, 100).collect()}
        for g in found["groups"]:
            assert g["bootstrap" if c != "prediction" else "rate_bootstrap"]["mean_low"] == pytest.approx(groups[g["group"]].mean_low)


def test_keys_of_windows_meet_once(spark, monkeypatch):
    """Repeats, labels and gaps are found in one table of keys; the messages are those of the separate checks, in their order."""
    for name in ("cross_label", "noncontiguous"):  # a shuffle of all keys each before
        monkeypatch.setattr(corpus, name, lambda rows, name=name: pytest.fail(f"{name} shuffles the windows again"))
    whole = [("f", k, f"p{k // 2}", k % 2, 1, 1, [2, k, 3], [1, 1, 1], [0, 0, 0]) for k in range(40)]
    assert corpus.validated(_windows(spark)).count() == len(whole)
    bad = [("g", 1, "p9", 0, 0, 0, [2, 18, 3], [1, 1, 1], [0, 0, 0]), ("g", 2, "p3", 3, 1, 1, [2, 9, 3], [1, 1, 1], [0, 0, 0]), ("g", 3, "q", 1, 1, 1, [2, 9, 3], [1, 1, 1], [0, 0, 0])]
    with pytest.raises(ValueError) as found:
        corpus.validated(_windows(spark, bad))
    assert str(found.value) == "both labels: p9; conflicting payloads: p9; non-contiguous chunk indices: p3; non-contiguous chunk indices: q"


def test_articles_of_checked_windows_are_one_aggregation(spark):
    twice = _windows(spark, [(path, 7, "p3", k, 1, 0, [2, 6 + k, 3], [1, 1, 1], [0, 0, 0]) for k in (0, 1) for path in ("g", "e")][:3])
    windows = corpus.validated(twice)
    got, want = corpus.articles_of(windows), corpus.articles(windows.withColumn("path", F.explode("sources")))  # which shuffles windows and paths, before
    assert got.dtypes == want.dtypes and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {tuple(r.sources) for r in got.collect()} == {("f",), ("e", "f", "g")}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1 < want._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")

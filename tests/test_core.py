"""Facts that the operators are held to, on small frames."""

import hashlib
import itertools
import json
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veriscreen import cli
from veriscreen.functions import ranking, stats, text, wordpiece
from veriscreen.operators import articles as A
from veriscreen.operators import audit, cohorts, corpus, release, scoring
from veriscreen.plans import queries as plans
from veriscreen.sources import files, markup, sinks
from veriscreen.streaming import incremental


def rows(df):
    return [tuple(r) for r in df.collect()]


def windows_of(n, cap, overlap):
    out, start = [], 0
    while start < n:
        out.append((start, min(start + cap, n)))
        if start + cap >= n:
            break
        start += cap - overlap
    return out


def test_windows(spark):
    df = spark.createDataFrame([(n, list(range(n))) for n in (1, 6, 7, 9, 14, 15, 40)], "n int, ids array<int>")
    got = rows(text.windows(df, "ids", 8, 2).select("n", "chunk_index", "chunk"))
    want = [(n, k, list(range(a, b))) for n in (1, 6, 7, 9, 14, 15, 40) for k, (a, b) in enumerate(windows_of(n, 6, 2))]
    assert sorted(got) == sorted(want)
    assert [c for n, k, c in sorted(got) if n == 9] == [list(range(6)), list(range(4, 9))]
    with pytest.raises(ValueError):
        text.windows(df, "ids", 8, 6)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 300), st.integers(1, 40), st.integers(0, 39))
def test_window_count_formula(n, cap, overlap):
    if overlap >= cap:
        return
    step = cap - overlap
    k = 0 if n == 0 else 1 if n <= cap else (n - cap + step - 1) // step + 1
    assert k == len(windows_of(n, cap, overlap))


def test_padding(spark):
    df = spark.createDataFrame([(1, [5, 6]), (1, [5, 6, 7]), (2, [9])], "b int, ids array<int>")
    got = sorted(rows(text.pad_batches(df, "b", "ids").select("b", "ids", "attention_mask", "token_type_ids")))
    assert got == [(1, [5, 6, 0], [1, 1, 0], [0, 0, 0]), (1, [5, 6, 7], [1, 1, 1], [0, 0, 0]), (2, [9], [1], [0])]


SCORES = [("a", 0, 0.1), ("b", 0, 0.4), ("c", 1, 0.6), ("d", 1, 0.9)]


def scored(spark, values=SCORES):
    return spark.createDataFrame(values, "pmid string, label int, mean_positive_probability double")


def test_article_mean_and_threshold(spark):
    chunks = spark.createDataFrame([("a", 0, 1, 0.2), ("a", 1, 1, 0.8), ("b", 0, 0, 0.1)], "pmid string, chunk_index int, label int, positive_probability double")
    assert sorted(rows(A.article_scores(chunks).select("pmid", "label", "n_chunks", "mean_positive_probability"))) == [("a", 1, 2, 0.5), ("b", 0, 1, 0.1)]
    assert A.prediction_violations(chunks).count() == 0
    best = A.choose_threshold(scored(spark)).first()
    assert best.threshold == 0.6 and best.youden == 1.0 and best.n_candidates == 6
    assert A.auroc(scored(spark)).first().auroc == 1.0


def brute_threshold(values, objective):
    best = None
    for t in sorted({0.0, 1.0, *(s for _, _, s in values)}):
        tp, fp = (sum(s >= t for _, y, s in values if y == k) for k in (1, 0))
        p, n = (sum(y == k for _, y, _ in values) for k in (1, 0))
        sens, spec = tp / p, (n - fp) / n
        f1 = 2 * tp / (tp + fp + p) if tp + fp + p else 0.0
        key = ({"youden": sens + spec - 1.0, "f1": f1, "balanced_accuracy": (sens + spec) / 2}[objective], spec, sens, t)
        best = max(best or key, key)
    return best


@pytest.mark.parametrize("objective", A.OBJECTIVES)
def test_threshold_auroc_and_precision_against_brute_force(spark, objective):
    rng = random.Random(7)
    values = [(str(i), int(rng.random() < 0.4), rng.choice([0.0, 1.0, *(k / 20 for k in range(21))])) for i in range(120)]
    got = A.choose_threshold(scored(spark, values), objective).first()
    assert (got.objective_value, got.specificity, got.sensitivity_recall, got.threshold) == pytest.approx(brute_threshold(values, objective))
    pairs = [(a > b) + 0.5 * (a == b) for _, y, a in values if y for _, z, b in values if not z]
    assert A.auroc(scored(spark, values)).first().auroc == pytest.approx(np.mean(pairs))
    total, last, area = sum(y for _, y, _ in values), 0.0, 0.0
    for t in sorted({s for *_, s in values}, reverse=True):
        tp = sum(y for _, y, s in values if s >= t)
        area += (tp / total - last) * tp / sum(s >= t for *_, s in values)
        last = tp / total
    assert A.average_precision(scored(spark, values)).first().average_precision == pytest.approx(area)


def test_single_class_metrics(spark):
    one = A.metrics(A.decide(scored(spark, [("a", 1, 0.8), ("b", 1, 0.2)]), 0.5)).first()
    assert one.sensitivity_recall == 0.5 and one.false_negative_rate == 0.5 and one.single_class_evaluation
    assert all(one[c] is None for c in ("specificity", "accuracy", "auroc", "f1", "mcc", "brier_score", "npv", "average_precision"))


def test_prefix_sums_across_parts(spark):
    values = [(k / 999, k % 7) for k in range(1000)]
    df = spark.createDataFrame(values, "s double, v long")
    got = dict(rows(ranking.prefix_sums(df, [], "s", {"t": "v"}, parts=16).select("s", "t")))
    total = 0
    for s, v in reversed(values):
        total += v
        assert got[s] == total


def chunk_rows(spark, values):
    return corpus.with_defaults(spark.createDataFrame(values, "path string, line long, pmid string, chunk_index int, label int, original_label int, input_ids array<int>, attention_mask array<int>, token_type_ids array<int>"))


GOOD = [("p", 1, "p1", 0, 1, 0, [1, 2], [1, 1], None), ("n", 1, "n1", 0, 0, 0, [3], [1], None), ("n", 2, "n1", 1, 0, 1, [4], [1], [0]), ("m", 1, "n1", 0, 0, None, [3], [1], None)]


def test_loading_merges_and_counts(spark):
    df = chunk_rows(spark, GOOD)
    merged = corpus.validated(df)
    assert sorted(rows(merged.select("pmid", "chunk_index", "sources"))) == [("n1", 0, ["m", "n"]), ("n1", 1, ["n"]), ("p1", 0, ["p"])]
    assert sorted(rows(corpus.load_stats(df).select("path", "lines", "new_chunks", "duplicate_chunks_merged", "label_overrides"))) == [("m", 1, 1, 0, 1), ("n", 2, 1, 1, 1), ("p", 1, 1, 0, 1)]
    assert ("m", "None", 1) in rows(corpus.original_label_counts(df))


BAD = [
    (("p", 9, None, 0, 1, 1, [1], [1], None), "missing_pmid"), (("p", 9, "", 0, 1, 1, [1], [1], None), "empty_pmid"), (("p", 9, "x", -1, 1, 1, [1], [1], None), "chunk_index"), (("p", 9, "x", 0, 1, 1, [], [], None), "empty_array"),
    (("p", 9, "x", 0, 1, 1, [1, 2], [1], None), "unequal_lengths"), (("p", 9, "x", 0, 1, 1, [1] * 9, [1] * 9, None), "too_long"), (("p", 9, "x", 0, 1, 1, [-1], [1], None), "negative_id"), (("p", 9, "x", 0, 1, 1, [1], [2], None), "mask_values"),
    (("p", 9, "x", 0, 1, 1, [1], [0], None), "mask_all_zero"), (("p", 9, "x", 0, 1, 1, [1], [1], [-1]), "negative_type"), (("p", 9, "x", 0, 1, 1, [50], [1], None), "id_beyond_vocabulary"),
]


def test_row_violations(spark):
    df = chunk_rows(spark, [GOOD[0], *((r[0], k, *r[2:]) for k, (r, _) in enumerate(BAD, 10))])
    got = {(r.line, r.rule) for r in corpus.row_violations(df, max_length=8, vocabulary=50).collect()}
    assert {(k, rule) for k, (_, rule) in enumerate(BAD, 10)} <= got and not any(line == 1 for line, _ in got)


@pytest.mark.parametrize("extra, message", [(("p", 5, "n1", 0, 1, 1, [3], [1], None), "both labels"), (("n", 5, "n1", 0, 0, 0, [9], [1], None), "conflicting"), (("n", 5, "n1", 3, 0, 0, [9], [1], None), "non-contiguous")])
def test_corpus_violations_raise(spark, extra, message):
    with pytest.raises(ValueError, match=message):
        corpus.validated(chunk_rows(spark, [*GOOD, extra]))


def test_sampling_follows_hash_order(spark):
    ids = spark.createDataFrame([(f"p{k}",) for k in range(30)] * 2, "pmid string")
    key = lambda p: (hashlib.sha256(f"42\0{p}".encode()).digest(), p)
    assert [r.pmid for r in cohorts.sample(ids, 5).collect()] == sorted((f"p{k}" for k in range(30)), key=key)[:5]
    excluded = ids.where("pmid = 'p3'")
    assert "p3" not in [r.pmid for r in cohorts.sample_checked(ids, excluded, 29).collect()]
    with pytest.raises(ValueError, match="only 29"):
        cohorts.sample_checked(ids, excluded, 30)


def test_split_sizes():
    assert cohorts.split_sizes(24, 2 / 3, 1 / 6, 1 / 6) == (16, 4, 4)
    assert cohorts.split_sizes(60, 0.8, 0.1, 0.1) == (48, 6, 6)
    assert sum(cohorts.class_shares({0: 30, 1: 30}, 7).values()) == 7
    with pytest.raises(ValueError):
        cohorts.split_sizes(10, 0.8, 0.1, 0.2)


def test_stratified_split(spark):
    df = spark.createDataFrame([(f"p{k}", k % 2) for k in range(60)], "pmid string, label int")
    got = cohorts.stratified_split(df)
    assert sorted(rows(cohorts.split_summary(got))) == [("test", 6, 3, 3), ("train", 48, 24, 24), ("validation", 6, 3, 3)]
    assert got.select("pmid").distinct().count() == 60


def test_overlaps_and_lists(spark):
    sets = {"a": {1, 2, 3, 10}, "b": {2, 3}, "c": {99}}
    df = spark.createDataFrame([(str(p), c) for c, own in sets.items() for p in own], "pmid string, cohort string")
    names = spark.createDataFrame([(c, k) for k, c in enumerate(sets)], "cohort string, ord int")
    got = cohorts.overlap_matrix(df, names)
    assert sorted(rows(got)) == [(a, b, len(sets[a] & sets[b])) for a, b in itertools.combinations(sets, 2)]
    assert cohorts.table_differences(got, got).count() == 0
    lines = spark.createDataFrame([("a", k, p) for k, p in enumerate(["2", "10", "9", "09", "11", "11"])], "cohort string, line int, pmid string")
    assert {(r.rule, r.line) for r in cohorts.list_violations(lines).collect()} == {("not ascending", 2), ("not numeric", 3), ("not ascending", 5)}
    assert [r.pmid for r in cohorts.numeric_ids(lines).collect()] == ["2", "9", "10", "11"]


def test_intervals_and_effects(spark):
    low, high = stats.wilson(F.lit(1), F.lit(3))
    z, p, n = stats.z_value(0.95), 1 / 3, 3
    middle, half = (p + z * z / (2 * n)) / (1 + z * z / n), z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    got = spark.range(1).select(low, high).first()
    assert tuple(got) == pytest.approx((middle - half, middle + half))
    rng = random.Random(3)
    values = [(str(i), g, 0, rng.random() * (1 + (g == "y")) / 2) for g in "xy" for i in range(20)]
    df = A.decide(spark.createDataFrame(values, "pmid string, g string, label int, mean_positive_probability double"), 0.5)
    x, y = ([v for *_, g, _, v in values if g == k] for k in "xy")
    pooled = math.sqrt((np.var(x, ddof=1) + np.var(y, ddof=1)) / 2)
    assert audit.pairwise(df, "g").first().cohens_d == pytest.approx((np.mean(x) - np.mean(y)) / pooled)
    means = [r["mean"] for r in audit.resampled(df, "g", "mean_positive_probability", 200).where("g = 'x'").collect()]
    assert len(means) == 200 and abs(np.mean(means) - np.mean(x)) < 0.02 and np.std(means) == pytest.approx(np.std(x) / math.sqrt(20), rel=0.25)
    one = spark.createDataFrame([("a", "x", 0, 0.5)], "pmid string, g string, label int, mean_positive_probability double")
    assert audit.group_summary(A.decide(one, 0.5), "g").first().sample_variance is None


def test_bootstraps_draw_as_many_replicates_as_the_reference(spark):
    values = [("x", f"p{i}", (i * i % 7) / 7) for i in range(6)] + [("y", f"q{i}", i / 5) for i in range(4)]
    df = spark.createDataFrame(values, "g string, pmid string, s double")
    want = {}
    for g in "xy":
        own = [v for _, _, v in sorted((x for x in values if x[0] == g), key=lambda x: hashlib.md5(x[1].encode()).hexdigest())]
        draws = np.array([[own[int(hashlib.md5(f"42:{g}:{r}:{d}".encode()).hexdigest()[:8], 16) % len(own)] for d in range(len(own))] for r in range(10_000)])
        want[g] = draws.mean(axis=1), draws.var(axis=1, ddof=1)
    q = [0.025, 0.975]
    for g, *got in rows(audit.bootstrap(df, "g", "s")):
        assert got == pytest.approx([*np.quantile(want[g][0], q), *np.quantile(want[g][1], q)])
    assert rows(audit.bootstrap_differences(df, "g", "s"))[0][2:] == pytest.approx(tuple(np.quantile(want["x"][0] - want["y"][0], q)))
    own = plans.decided(spark, "/root/testdata/sf0.001")
    want = plans.rounded(audit.bootstrap(own, "lang", "mean_positive_probability", 10_000))
    assert sorted(rows(plans.bootstrap_mean_ci(spark, "/root/testdata/sf0.001"))) == sorted(rows(want))



def test_pairs(spark):
    df = spark.createDataFrame([(1, "p", "A", 1), (1, "p", "B", 0), (1, "q", "A", 1), (1, "q", "B", 1), (1, "r", "A", 0)], "e int, pair string, style string, prediction int")
    assert rows(audit.paired_outcomes(df, "e", "pair", "style")) == [(1, 1, 0, 1, 0, 2)]
    assert [r.pair for r in audit.pair_violations(df, "pair", "style").collect()] == ["r"]


def test_schedules_and_selection():
    assert scoring.learning_rate(5, 100, 0.1) == 0.5 and scoring.learning_rate(10, 100, 0.1) == 1 and scoring.learning_rate(100, 100, 0.1) == 0
    assert scoring.best_epoch([(1, 0.5, 0.8), (2, 0.4, 0.7), (3, 0.4, 0.9), (4, 0.41, 1.0)]) == 3


def test_model_slot(spark):
    chunks = spark.createDataFrame([("a", [1, 2], [1, 1], [0, 0]), ("b", [3], [1], [0])], "pmid string, input_ids array<int>, attention_mask array<int>, token_type_ids array<int>")
    got = scoring.score_batches(chunks, lambda: lambda batch: batch["input_ids"].map(len) / 10)
    assert sorted(rows(got)) == [("a", 0.2), ("b", 0.1)]


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n", encoding="utf-8")
    return str(path)


def test_strict_lines(spark, tmp_path):
    good = write(tmp_path / "a.jsonl", ["﻿" + json.dumps({"pmid": 5, "chunk_index": 0, "label": 1, "input_ids": [1], "attention_mask": [1]}), "", {"pmid": " 6 ", "chunk_index": 0, "label": 0, "input_ids": [1], "attention_mask": [1]}])
    got = files.labelled_chunks(spark, positive=[good])
    assert sorted(rows(got.select("pmid", "line", "label", "original_label"))) == [("5", 1, 1, 1), ("6", 3, 1, 0)]
    for bad in ("[1]", "{", '{"pmid": "x", "chunk_index": true}', '{"pmid": "x", "chunk_index": 1.5}', '{"pmid": "x", "input_ids": ["a"]}'):
        path = write(tmp_path / "b.jsonl", [{"pmid": "1"}, bad])
        with pytest.raises(files.InvalidInput, match="b.jsonl:2: invalid JSON"):
            files.labelled_chunks(spark, positive=[path])
    with pytest.raises(files.InvalidInput, match="once over both roles"):
        files.role_paths([good], [good])


def test_id_exports(spark, tmp_path):
    a = write(tmp_path / "a.jsonl", [{"pmid": "123"}, {"pmid": 123}, {"pmid": "456"}])
    assert sorted(rows(files.numeric_json_ids(spark, [a]))) == [("123",), ("456",)]
    with pytest.raises(files.InvalidInput):
        files.numeric_json_ids(spark, [write(tmp_path / "b.jsonl", [{"pmid": "DEMO-1"}])])
    with pytest.raises(files.InvalidInput):
        files.numeric_json_ids(spark, [write(tmp_path / "m.json", [{"sampled_articles": 2, "sampled_pmids": [{"pmid": "1", "n_chunks": 1}]}])], "sampling-manifest")


def test_markup(spark):
    xml = """<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">7</PMID><Article><ArticleTitle>The <i>small</i> title</ArticleTitle><Abstract><AbstractText Label="A">One <b>bold</b> &amp; two.</AbstractText><AbstractText>Three.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>8</PMID><Article><ArticleTitle>No abstract</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
    got = markup.parse_articles(spark.createDataFrame([(xml,)], "xml string"), 1)
    assert sorted(rows(got)) == [("7", "The small title", "One bold & two.\nThree.", 1), ("8", "No abstract", "", 1)]
    assert rows(markup.missing_abstracts(got)) == [("8",)]
    with pytest.raises(Exception, match="too many"):
        markup.parse_articles(spark.createDataFrame([("<ERROR>too many</ERROR>",)], "xml string"), 1).collect()
    ids = spark.createDataFrame([(str(k),) for k in range(1, 251)], "pmid string")
    assert sorted(len(r.ids) for r in markup.request_batches(ids).collect()) == [50, 100, 100]


def test_fingerprints(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"hello\n")
    got = files.fingerprints(spark, [str(tmp_path / "x")]).first()
    assert got.size == 6 and got.sha256 == hashlib.sha256(b"hello\n").hexdigest() and got.git_sha1 == hashlib.sha1(b"blob 6\0hello\n").hexdigest()


def test_json_documents_refuse_to_overwrite(tmp_path):
    sinks.write_json(str(tmp_path / "a.json"), {"s": {2, 1}})
    assert json.loads((tmp_path / "a.json").read_text()) == {"s": [1, 2]}
    with pytest.raises(FileExistsError):
        sinks.write_json(str(tmp_path / "a.json"), {})
    with pytest.raises(ValueError):
        sinks.write_json(str(tmp_path / "b.json"), {"x": math.nan})
    with pytest.raises(FileExistsError):
        sinks.new_dir(str(tmp_path))


def test_stream_adds_up(spark, tmp_path):
    chunks = spark.createDataFrame([("a", 0, 1, 0.2), ("a", 1, 1, 0.8), ("b", 0, 0, 0.1)], incremental.SCHEMA)
    for k in range(2):
        chunks.where(f"chunk_index = {k}").write.mode("append").parquet(str(tmp_path / "in"))
        incremental.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), once=True).awaitTermination()
    assert sorted(rows(incremental.article_scores(spark, str(tmp_path / "out")))) == [("a", 1, 2, 0.5), ("b", 0, 1, 0.1)]


def test_commands_end_to_end(spark, tmp_path):
    raw = [{"pmid": f"DEMO-{label}-{k}", "label": label, "data_status": "demo-only", "title": f"Title {k}", "abstract": "word " * (k + 3)} for label in (0, 1) for k in range(20)]
    for label in (0, 1):
        path = write(tmp_path / f"raw{label}.jsonl", [r for r in raw if r["label"] == label])
        cli.main(["preprocess", "--input", path, "--output", str(tmp_path / f"chunks{label}"), "--max-length", "12", "--overlap", "2"], spark)
    own = ["--positive", str(tmp_path / "chunks1"), "--negative", str(tmp_path / "chunks0"), "--max-length", "12"]
    cli.main(["train", *own, "--output-dir", str(tmp_path / "run"), "--train-ratio", "0.5", "--validation-ratio", "0.25", "--test-ratio", "0.25"], spark)
    manifest = json.loads((tmp_path / "run/split_manifest.json").read_text())
    assert len(manifest["articles"]) == 40 and manifest["summary"]["test"]["articles"] == 10
    with pytest.raises(ValueError, match="training manifest"):
        cli.main(["evaluate", *own, "--output-dir", str(tmp_path / "ev0"), "--threshold-file", str(tmp_path / "run/threshold.json"), "--training-manifest", str(tmp_path / "run/split_manifest.json")], spark)
    cli.main(["evaluate", *own, "--output-dir", str(tmp_path / "ev"), "--threshold", "0.5"], spark)
    cli.main(["evaluate", "--positive", str(tmp_path / "chunks1"), "--max-length", "12", "--output-dir", str(tmp_path / "ev2"), "--threshold", "0.5"], spark)
    assert json.loads((tmp_path / "ev/external_results.json").read_text())["metrics"]["n_articles"] == 40
    cli.main(["sample", "--input", str(tmp_path / "chunks0"), "--label", "0", "--n-articles", "5", "--output", str(tmp_path / "sampled"), "--max-length", "12"], spark)
    assert json.loads((tmp_path / "sampled.manifest.json").read_text())["sampled_articles"] == 5
    cli.main(["analyze", "--group", f"a={tmp_path}/ev/predictions", "--group", f"b={tmp_path}/ev2/predictions", "--output-dir", str(tmp_path / "an"), "--bootstrap-replicates", "100"], spark)
    analysis = json.loads((tmp_path / "an/analysis.json").read_text())
    assert [g["n_articles"] for g in analysis["groups"]] == [40, 20] and len(analysis["pairwise_comparisons"]) == 1 and "| a | 40 |" in (tmp_path / "an/analysis.md").read_text()
    cli.main(["filter-overlap", "--input", str(tmp_path / "chunks0"), "--exclude", str(tmp_path / "sampled"), "--output", str(tmp_path / "left"), "--removed-ids", str(tmp_path / "gone")], spark)
    assert spark.read.text(str(tmp_path / "gone")).count() == 5


def test_wordpiece(spark, tmp_path):
    path = write(tmp_path / "vocab.txt", ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "blue", "shape", "##s"])
    encode = wordpiece.encoder(wordpiece.read_vocabulary(path))
    df = spark.createDataFrame([("Blue shapes xyz",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(encode("t")).collect()] == [[4, 5, 6, 1], None, []]
    with pytest.raises(ValueError, match="SEP"):
        wordpiece.read_vocabulary(write(tmp_path / "bad.txt", ["[CLS]"]))


def test_release_gates(spark):
    manifest = spark.createDataFrame([("a", "verified-historical", False), ("b", "demo-only", False), ("c", "verified-historical", None)], "cohort string, data_status string, verified boolean")
    assert sorted(r.cohort for r in release.provenance_violations(manifest).collect()) == ["b", "c"]
    schema = "name string, size long, git_sha1 string, rows long, ids long"
    expected, found = spark.createDataFrame([("x", 5, "h", 2, 2), ("y", 1, "g", 1, 1)], schema), spark.createDataFrame([("x", 5, "z", 2, 2)], schema)
    assert sorted(rows(release.blob_violations(found, expected))) == [("x", "git_sha1"), *sorted(("y", c) for c in ("size", "git_sha1", "rows", "ids"))]
    recorded = spark.createDataFrame([("p", 2), ("q", 1)], "pmid string, n_chunks int")
    chunks = spark.createDataFrame([("p", 0), ("p", 1), ("r", 0)], "pmid string, chunk_index int")
    assert sorted(rows(release.sampled_differences(recorded, chunks))) == [("q", 1, "manifest"), ("r", 1, "file")]
    assert release.check_threshold({"threshold": 0.4, "run_id": "a"}, "a") == 0.4
    for bad in ({"threshold": True}, {"threshold": 1.5}, {"threshold": 0.4, "run_id": "b"}, {"threshold": 0.4, "run_id": "a", "aggregation": "max"}):
        with pytest.raises(ValueError):
            release.check_threshold(bad, "a")


def test_manifests(spark):
    articles = spark.createDataFrame([("1", "t", ""), ("2", "t", "a")], "pmid string, title string, abstract string")
    assert sinks.retrieval_manifest(articles, 2, "e", "t", {})["missing_abstracts"] == ["1"]
    assert sinks.preprocess_manifest(articles, articles, {"overlap": 2}, {"v": "h"})["articles"] == 2


def test_quantiles_by_running_counts(spark):
    rng = np.random.default_rng(5)
    data = [(g, round(float(x), 2)) for g, n in (("a", 700), ("b", 1), ("c", 2)) for x in rng.random(n)]
    counted = spark.createDataFrame(data, "g string, s double").groupBy("g", "s").agg(F.count("*").alias("n"))
    levels = (0.0, 0.025, 0.25, 0.5, 0.975, 1.0)
    got = {r.g: r.q for r in ranking.quantiles(counted, ["g"], "s", "n", levels).collect()}
    for g in "abc":
        assert np.allclose(got[g], np.quantile([x for k, x in data if k == g], levels))
    assert np.allclose(ranking.quantiles(counted.groupBy("s").agg(F.sum("n").alias("n")), [], "s", "n", levels).first().q, np.quantile([x for _, x in data], levels))


def test_lists_are_checked_across_parts(spark, monkeypatch):
    monkeypatch.setattr(cohorts, "LINES", 3)
    ids = ["1", "2", "10", "9", "11", "x", "12", "12", "13", "14"]
    df = spark.createDataFrame([("l", k + 1, x) for k, x in enumerate(ids)], "cohort string, line long, pmid string")
    want = [(k + 1, "not numeric" if not x.isdigit() else "not ascending") for k, x in enumerate(ids) if not x.isdigit() or k and (len(ids[k - 1]), ids[k - 1]) >= (len(x), x)]
    assert sorted((r.line, r.rule) for r in cohorts.list_violations(df).collect()) == sorted(want)


def test_requests_are_numbered_across_parts(spark):
    ids = [str(k * 7) for k in range(1, 900)] + ["7", "14"]
    got = {r.batch: list(r.ids) for r in markup.request_batches(spark.createDataFrame([(x,) for x in ids], "pmid string"), 200).collect()}
    want = sorted(set(ids), key=int)
    assert got == {k: want[200 * k : 200 * k + 200] for k in range(-(-len(want) // 200))}


def test_metric_inputs_are_checked(spark):
    good = spark.createDataFrame([("a", 1, 0.5, 0.5)], "pmid string, label int, mean_positive_probability double, threshold double")
    assert A.checked(good) is good
    with pytest.raises(ValueError, match="no articles"):
        A.checked(good.limit(0))
    for bad in (("a", 2, 0.5, 0.5), ("a", 1, float("nan"), 0.5), ("a", 1, None, 0.5), ("a", 1, 0.5, 1.5)):
        with pytest.raises(ValueError):
            A.checked(spark.createDataFrame([bad], good.schema))


def test_queries_are_listed_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert len(q) > 100 and set(s) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__import__("pathlib").Path(__file__).parent.parent)


def test_cuts_of_prefix_sums_stay_out_of_the_plan(spark):
    df = spark.createDataFrame([(k / 999, 1) for k in range(1000)] + [(None, 1)], "s double, v long")
    few, many = (len(ranking.prefix_sums(df, [], "s", {"t": "v"}, parts=n)._jdf.queryExecution().optimizedPlan().toString()) for n in (4, 200))
    assert many < 1.2 * few
    got = {r.s: r.t for r in ranking.prefix_sums(df, [], "s", {"t": "v"}, parts=8).collect()}
    assert got[None] == 1001 and got[0.0] == 1000 and got[1.0] == 1

"""The commands as a user runs them: training and evaluation with gates, comparison of groups, recovery and release."""

import csv
import hashlib
import itertools
import json
import os

import pytest

from veriscreen import cli
from veriscreen.operators import release


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((x if isinstance(x, str) else json.dumps(x)) + "\n" for x in rows), encoding="utf-8")
    return str(path)


def chunk(pmid, label, word):
    return {"pmid": pmid, "chunk_index": 0, "label": label, "input_ids": [2, word, word, 3], "attention_mask": [1] * 4, "token_type_ids": [0] * 4}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """A trained run: positives hold token 5, negatives token 6, and positives' own labels say 0."""
    home = tmp_path_factory.mktemp("run")
    positive, negative = lines(home / "p.jsonl", [chunk(f"p{k}", 0, 5) for k in range(16)]), lines(home / "n.jsonl", [chunk(f"n{k}", 0, 6) for k in range(16)])
    cli.main(["train", "--positive", positive, "--negative", negative, "--output-dir", str(home / "out"), "--vocab-size", "7", "--type-vocab-size", "2", "--train-ratio", "0.5", "--validation-ratio", "0.25", "--test-ratio", "0.25", "--epochs", "2"], spark)
    return home


def test_training_gives_all_documents_and_a_model_that_learned(run):
    read = lambda name: json.loads((run / "out" / name).read_text())
    config, frozen, results, manifest = (read(f"{x}.json") for x in ("run_config", "threshold", "internal_results", "split_manifest"))
    assert config["config"]["run_id"] == frozen["run_id"] == results["run_id"]
    assert results["metrics"]["auroc"] == 1.0 and results["internal_test"]["chunk_loss"] < 0.69 and len(read("training_history.json")["epochs"]) == 2
    assert manifest["sources"] and {x["role"] for x in manifest["input_files"]} == {"positive", "negative"} and sum(s["label_overrides"] for s in manifest["sources"]) == 16
    assert manifest["input_files"][0]["sha256"] == hashlib.sha256((run / ("p.jsonl" if manifest["input_files"][0]["role"] == "positive" else "n.jsonl")).read_bytes()).hexdigest()


def test_evaluation_uses_the_runs_model_and_threshold(spark, run):
    positive, negative = lines(run / "xp.jsonl", [chunk(f"xp{k}", 0, 5) for k in range(2)]), lines(run / "xn.jsonl", [chunk(f"xn{k}", 1, 6) for k in range(2)])
    cli.main(["evaluate", "--positive", positive, "--negative", negative, "--model-dir", str(run / "out/best_model"), "--output-dir", str(run / "ev"), "--save-chunk-predictions"], spark)
    found = json.loads((run / "ev/external_results.json").read_text())
    assert found["metrics"]["n_articles"] == 4 and found["metrics"]["accuracy"] == 1.0 and found["chunk_loss"] < 0.69 and sum(s["label_overrides"] for s in found["sources"]) == 4
    assert spark.read.json(str(run / "ev/chunk_predictions")).count() == 4 and len(found["input_files"]) == 2 and found["training_overlap_pmids"] == []
    with pytest.raises(ValueError, match="training manifest"):
        cli.main(["evaluate", "--positive", str(run / "p.jsonl"), "--model-dir", str(run / "out/best_model"), "--output-dir", str(run / "ev1")], spark)
    other = json.loads((run / "out/threshold.json").read_text()) | {"run_id": "another"}
    (run / "other.json").write_text(json.dumps(other))
    with pytest.raises(ValueError, match="another run"):
        cli.main(["evaluate", "--positive", positive, "--model-dir", str(run / "out/best_model"), "--threshold-file", str(run / "other.json"), "--output-dir", str(run / "ev2")], spark)
    with pytest.raises(ValueError, match="id_beyond_vocabulary"):
        cli.main(["evaluate", "--positive", lines(run / "big.jsonl", [chunk("z", 1, 7)]), "--model-dir", str(run / "out/best_model"), "--output-dir", str(run / "ev3")], spark)
    with pytest.raises(ValueError, match="exceeds the model"):
        cli.main(["evaluate", "--positive", positive, "--model-dir", str(run / "out/best_model"), "--max-length", "513", "--output-dir", str(run / "ev4")], spark)


def test_groups_are_compared_in_the_order_of_the_command(spark, tmp_path):
    row = lambda k, y, p: {"pmid": k, "label": y, "n_chunks": 1, "mean_positive_probability": p, "prediction": int(p >= 0.5), "threshold": 0.5, "sources": ["s"]}
    a = lines(tmp_path / "a.jsonl", [row(f"a{i}", i % 2, p) for i, p in enumerate((0.1, 0.4, 0.8))])
    b = lines(tmp_path / "b.jsonl", [row(f"b{i}", i % 2, p) for i, p in enumerate((0.2, 0.3, 0.4))])
    cli.main(["analyze", "--group", f"second={a}", "--group", f"first={b}", "--output-dir", str(tmp_path / "out"), "--bootstrap-replicates", "200"], spark)
    found = json.loads((tmp_path / "out/analysis.json").read_text())
    (pair,) = found["pairwise_comparisons"]
    assert [g["group"] for g in found["groups"]] == ["second", "first"] and (pair["first_group"], pair["second_group"]) == ("second", "first")
    assert pair["mean_difference"] == pytest.approx(1.3 / 3 - 0.3) and pair["rate_difference"] == pytest.approx(1 / 3) and pair["rate_low"] <= 1 / 3 <= pair["rate_high"]
    assert found["frozen_threshold"] == 0.5 and found["groups"][0]["rate_bootstrap"]["mean_low"] >= 0 and len(found["groups"][0]["quantiles"]) == 7
    text = (tmp_path / "out/analysis.md").read_text()
    assert "sample variance" in text and "rate interval" in text


def blob(raw):
    return hashlib.sha1(f"blob {len(raw)}\0".encode() + raw).hexdigest()


def archive(tmp_path, change=b""):
    raw = b'{"pmid": 30}\n{"pmid": "4"}\n{"pmid": "4"}\n'
    (tmp_path / "archive/in").mkdir(parents=True)
    (tmp_path / "archive/in/x.jsonl").write_bytes(raw + change)
    (tmp_path / "archive/in/s.json").write_text(json.dumps({"sampled_pmids": [{"pmid": "30", "n_chunks": 1}, {"pmid": "4", "n_chunks": 2}]}))
    entry = {"path": "x.txt", "source_path": "in/x.jsonl", "source_bytes": len(raw), "source_rows": 3, "source_git_blob_sha": blob(raw), "unique_pmids": 2, "sampling_evidence": {"source_path": "in/s.json"}}
    (tmp_path / "manifest.json").write_text(json.dumps({"cohorts": [entry]}))
    return ["recover", "--archive", str(tmp_path / "archive"), "--manifest", str(tmp_path / "manifest.json"), "--output-dir", str(tmp_path / "out")]


def test_recovery_writes_sorted_ids_of_verified_blobs(spark, tmp_path):
    cli.main(archive(tmp_path), spark)
    assert [r.value for r in spark.read.text(str(tmp_path / "out/x.txt")).collect()] == ["4", "30"]


def test_recovery_of_an_altered_blob_writes_nothing(spark, tmp_path):
    with pytest.raises(ValueError, match="git_sha1 differs"):
        cli.main(archive(tmp_path, b" "), spark)
    assert os.listdir(tmp_path / "out") == []


def released(tmp_path, **changes):
    sets = {n: [str(100 * i + k) for k in range(1, 4)] for i, n in enumerate((*release.INTERNAL, release.CHINA, release.OTHER, release.POSITIVE), 1)}
    sets[release.CLEAN] = ["5000"]
    sets[release.RAW] = ["101", "5000"]
    cohorts = []
    for name, ids in sets.items():
        raw = "".join(f"{x}\n" for x in ids).encode()
        (tmp_path / f"{name}.txt").write_bytes(raw)
        cohorts.append({"cohort_id": name, "path": f"{name}.txt", "unique_pmids": len(ids), "pmid_file_sha256": hashlib.sha256(raw).hexdigest(), "data_status": "verified-historical", "paper_cohort_verified": False})
    checks = dict.fromkeys(("audit_group_overlap", "audit_china_internal_overlap", "audit_other_internal_overlap", "audit_china_external_positive_overlap", "audit_other_external_positive_overlap", "audit_other_external_negative_overlap"), 0)
    checks |= {"internal_unique_articles": 12, "external_raw_internal_overlap": 1, "clean_equals_raw_minus_internal": True}
    manifest = {"data_status": "verified-historical", "paper_cohort_verified": False, "distinct_pmids_across_all_lists": 22, "checks": checks, "cohorts": cohorts} | changes
    (tmp_path / "manifest.json").write_text(json.dumps(manifest))
    with open(tmp_path / "overlap_counts.csv", "w", newline="") as file:
        out = csv.writer(file)
        out.writerow(["cohort_a", "cohort_b", "shared_pmids"])
        out.writerows([a, b, len({*sets[a]} & {*sets[b]})] for a, b in itertools.combinations(sets, 2))
    return ["verify-release", "--root", str(tmp_path)]


def test_release_is_verified_in_full(spark, tmp_path, capsys):
    cli.main(released(tmp_path), spark)
    assert "9 cohorts verified, 22 distinct ids" in capsys.readouterr().out


@pytest.mark.parametrize("changes, message", [({"distinct_pmids_across_all_lists": 23}, "distinct ids"), ({"checks": {"internal_unique_articles": 11}}, "relationship checks"), ({"paper_cohort_verified": True}, "provenance")])
def test_release_that_differs_is_refused(spark, tmp_path, changes, message):
    with pytest.raises(ValueError, match=message):
        cli.main(released(tmp_path, **changes), spark)


def test_release_without_a_list_is_refused(spark, tmp_path):
    args = released(tmp_path)
    (tmp_path / f"{release.CHINA}.txt").unlink()
    with pytest.raises(FileNotFoundError):
        cli.main(args, spark)


def test_fetch_keeps_what_a_client_returns(spark, tmp_path):
    from types import SimpleNamespace

    ids = lines(tmp_path / "ids.txt", ["7", "12"])
    article = lambda k: f"<PubmedArticle><MedlineCitation><PMID>{k}</PMID><Article><ArticleTitle>T{k}</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    own = lambda name: SimpleNamespace(pmids=ids, label=1, output_dir=str(tmp_path / name), batch_size=1)
    cli.fetch(spark, own("a"), lambda batch: f"<PubmedArticleSet>{''.join(map(article, batch))}</PubmedArticleSet>")
    assert [(r.pmid, r.title, r.data_status) for r in spark.read.json(str(tmp_path / "a/articles")).orderBy("pmid").collect()] == [("12", "T12", "reconstruction"), ("7", "T7", "reconstruction")]
    assert json.loads((tmp_path / "a/retrieval_manifest.json").read_text())["missing_abstracts"] == ["7", "12"] and len(os.listdir(tmp_path / "a")) == 4
    with pytest.raises(ValueError, match="differ"):
        cli.fetch(spark, own("b"), lambda batch: f"<PubmedArticleSet>{article(99)}</PubmedArticleSet>")
    with pytest.raises(ValueError, match="no client"):
        cli.fetch(spark, own("c"))


def test_preprocessing_refuses_what_has_no_tokens(spark, tmp_path):
    row = {"pmid": "DEMO-1", "title": "\n", "abstract": "\n\t", "label": 1, "data_status": "demo-only"}
    with pytest.raises(ValueError, match="no text"):
        cli.main(["preprocess", "--input", lines(tmp_path / "a.jsonl", [row]), "--output", str(tmp_path / "o1")], spark)
    good = lines(tmp_path / "b.jsonl", [row | {"title": "\nblue ", "abstract": "\vshapes here"}])
    with pytest.raises(ValueError, match="data_status"):
        cli.main(["preprocess", "--input", good, "--output", str(tmp_path / "o2"), "--status", "reconstruction"], spark)
    cli.main(["preprocess", "--input", good, "--output", str(tmp_path / "o3"), "--status", "demo-only"], spark)
    manifest = json.loads((tmp_path / "o3.manifest.json").read_text())
    assert (manifest["articles"], manifest["chunks"]) == (1, 1) and len(spark.read.json(str(tmp_path / "o3")).first().input_ids) == 5


def test_demo_runs_the_whole_workflow(spark, tmp_path):
    cli.main(["demo", "--output-dir", str(tmp_path / "demo")], spark)
    found = json.loads((tmp_path / "demo/external_test/external_results.json").read_text())
    assert found["metrics"]["n_articles"] == 8 and found["metrics"]["auroc"] == 1.0


def full_archive(tmp_path, **changes):
    raw = b'{"pmid": 30}\r\n{"pmid": "4"}\n\n{"pmid": "4"}'
    (tmp_path / "archive/in").mkdir(parents=True)
    (tmp_path / "archive/in/x.jsonl").write_bytes(raw)
    sampled = json.dumps({"output": {"sha256": changes.get("output", hashlib.sha256(raw).hexdigest())}, "sampled_pmids": [{"pmid": "30", "n_chunks": 1}, {"pmid": "4", "n_chunks": 2}]}).encode()
    (tmp_path / "archive/in/s.json").write_bytes(sampled)
    entry = {"path": "x.txt", "source_path": "in/x.jsonl", "source_bytes": len(raw), "source_rows": 3, "source_git_blob_sha": blob(raw), "unique_pmids": 2, "pmid_file_sha256": hashlib.sha256(changes.get("export", b"4\n30\n")).hexdigest(), "sampling_evidence": {"source_path": "in/s.json", "source_git_blob_sha": changes.get("evidence", blob(sampled))}}
    (tmp_path / "manifest.json").write_text(json.dumps({"cohorts": [entry]}))
    return ["recover", "--archive", str(tmp_path / "archive"), "--manifest", str(tmp_path / "manifest.json"), "--output-dir", str(tmp_path / "out")]


def test_recovery_checks_exports_and_samples(spark, tmp_path):
    cli.main(full_archive(tmp_path), spark)
    assert (tmp_path / "out/x.txt").read_bytes() == b"4\n30\n"


@pytest.mark.parametrize("changes, message", [({"export": b"30\n4\n"}, "sorted ids"), ({"export": b"4\n30"}, "sorted ids"), ({"output": "0" * 64}, "another file"), ({"evidence": "0" * 40}, "sampling manifest differs")])
def test_recovery_refuses_other_exports_and_samples(spark, tmp_path, changes, message):
    with pytest.raises(ValueError, match=message):
        cli.main(full_archive(tmp_path, **changes), spark)
    assert os.listdir(tmp_path / "out") == []


@pytest.mark.parametrize("arguments", ["train --output-dir x --epochs 0", "train --output-dir x --warmup-ratio 1", "train --output-dir x --learning-rate 0", "train --output-dir x --train-ratio 0", "analyze --group a=b --output-dir x --confidence-level 1", "analyze --group a=b --output-dir x --bootstrap-replicates 99", "evaluate --output-dir x --threshold 1.5", "fetch --pmids x --label 1 --output-dir x --batch-size 201", "sample --input x --label 1 --n-articles 0 --output x"])
def test_arguments_out_of_range_are_refused_before_anything_runs(arguments, capsys):
    with pytest.raises(SystemExit):
        cli.main(arguments.split(), None)
    assert "is not" in capsys.readouterr().err

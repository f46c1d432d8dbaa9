"""Command line: python -m veriscreen COMMAND ..., on the session of the environment."""

from __future__ import annotations

import argparse
import json
import os
import platform
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text, wordpiece
from .operators import articles as A
from .operators import audit, cohorts, corpus, release, scoring, training, window_model
from .sources import files, markup, service, sinks, storage
from .sources.scratch import drop, materialized, replaced, scratch


def _scorer(spark: SparkSession, a):
    """A function from windows to windows with positive_probability, and the scorer's settings: a trained model's, those
    of an ONNX file, or the surrogate's."""
    if getattr(a, "model_dir", None):
        model = window_model.WindowModel.load(spark, a.model_dir)
        return model.score, model.config
    if a.onnx_model:
        return lambda chunks: scoring.score_batches(chunks, scoring.onnx_scorer(a.onnx_model)), {"scorer": "onnx"}
    return lambda chunks: chunks.withColumn("positive_probability", scoring.surrogate(F.col("pmid"), F.col("chunk_index"))), {"scorer": "surrogate"}


def _load(spark: SparkSession, a, config: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """Merged windows and load statistics of role files; ids and types must fit the model's vocabularies."""
    if a.max_length < 1:
        raise ValueError("--max-length must be positive")
    config = config or {}
    if a.max_length > config.get("max_length", a.max_length):
        raise ValueError(f"--max-length={a.max_length} exceeds the model's {config['max_length']}")
    rows = corpus.with_defaults(files.labelled_chunks(spark, a.positive, a.negative))
    limits = {"vocabulary": config.get("vocab_size") or a.vocab_size, "types": config.get("type_vocab_size") or a.type_vocab_size}
    return corpus.validated(rows, max_length=a.max_length, **limits), corpus.load_stats(rows)


def _inputs(spark: SparkSession, paths) -> list[dict]:
    """Fingerprints of input files, those in a folder one by one."""
    return [r.asDict() for r in files.fingerprints(spark, list(paths)).orderBy("path").collect()] if paths else []


def _versions(spark: SparkSession) -> dict:
    """What a run was made with."""
    from importlib import metadata

    return {"spark": spark.version, "python": platform.python_version(), "platform": platform.platform(), **{name: metadata.version(name) for name in ("numpy", "pandas", "pyarrow")}}


def _scores(score, chunks: DataFrame) -> DataFrame:
    """Scored windows as a table without their arrays, which all that follows reads."""
    return materialized(score(chunks).drop("input_ids", "attention_mask", "token_type_ids"), "scores")


def _documents(scored: DataFrame, threshold: float) -> tuple[dict, DataFrame]:
    """Window loss, metrics and score summary, and the article rows that they are of."""
    rows = A.checked(materialized(A.decide(A.article_scores(scored).join(A.with_sources(scored), "pmid"), threshold), "articles"))  # read by several passes
    loss = scoring.mean_loss(scored).first().loss
    return {"chunk_loss": loss, "article_metrics": A.metrics(rows).first().asDict(), "score_summary": A.score_summary(rows).first().asDict()}, rows


def preprocess(spark: SparkSession, a) -> None:
    """Raw articles to windows; without a vocabulary file, words get hashes as ids, as no vocabulary is bundled."""
    rows = files.raw_articles(spark, a.input)
    if a.status and (bad := rows.where(~F.col("data_status").eqNullSafe(F.lit(a.status))).limit(5).collect()):
        raise ValueError(f"data_status is not {a.status}: {', '.join(r.pmid for r in bad)}")
    whole = text.compose(F.col("title"), F.col("abstract"))
    cls, sep = text.CLS, text.SEP
    if a.vocabulary_file:
        vocabulary = wordpiece.read_vocabulary(a.vocabulary_file)
        cls, sep = (vocabulary.index(x) for x in wordpiece.SPECIAL)
        ids = wordpiece.encoder(vocabulary)(whole)
    else:
        ids = F.transform(text.tokens(whole), lambda w: (F.pmod(F.xxhash64(w), F.lit(a.vocabulary - 1000)) + 1000).cast("int"))
    text.check_windows(a.max_length - 2, a.overlap)
    rows = materialized(rows.select("pmid", "label", "data_status", ids.alias("ids")), "tokens")  # texts are cut once; checks, sorting and writing read tokens
    if bad := rows.where(F.size("ids") < 1).limit(5).collect():
        raise ValueError(f"no tokens in {', '.join(r.pmid for r in bad)}")
    if rows.isEmpty():
        raise ValueError("no articles found")
    spread = text.windows(rows.orderBy("pmid"), "ids", a.max_length, a.overlap)  # an article's windows follow each other: articles are sorted, not windows
    whole, mask, kinds = text.wrap(F.col("chunk"), cls, sep)
    sinks.write_jsonl(spread.select("pmid", "chunk_index", "label", "data_status", whole.alias("input_ids"), mask.alias("attention_mask"), kinds.alias("token_type_ids")), a.output)
    made = spark.read.text(a.output)  # a line a window
    parameters = {"max_length": a.max_length, "overlap_content_tokens": a.overlap, "data_status": a.status, "inputs": _inputs(spark, a.input), "outputs": _inputs(spark, [a.output])}
    tokenizer = {r["path"]: r["sha256"] for r in _inputs(spark, [a.vocabulary_file])} if a.vocabulary_file else {}
    sinks.write_json(f"{a.output.rstrip('/')}.manifest.json", sinks.preprocess_manifest(rows, made, parameters, tokenizer))


def train(spark: SparkSession, a) -> None:
    """Split, a model or another scorer, a threshold on the validation part, metrics of the test part with both frozen."""
    settings = training.Settings(a.epochs, a.train_batch_size, a.gradient_accumulation_steps, a.learning_rate, a.weight_decay, a.warmup_ratio, a.scheduler_type, a.max_grad_norm, a.seed)
    out, began = sinks.new_dir(a.output_dir), time.time()
    run = f"{int(began)}-{os.getpid()}"
    chunks, stats = _load(spark, a)
    own = materialized(corpus.articles_of(chunks), "articles")
    split = materialized(cohorts.stratified_split(own, a.train_ratio, a.validation_ratio, a.test_ratio, a.seed), "split")
    fingerprints = [x | {"role": role} for role, paths in (("positive", a.positive), ("negative", a.negative)) for x in _inputs(spark, paths)]
    more = {"split_unit": "article/pmid", "stratified_by": "article label", "sources": [r.asDict() for r in stats.collect()], "input_files": fingerprints}
    sinks.write_split_manifest(f"{out}/split_manifest.json", split, (a.train_ratio, a.validation_ratio, a.test_ratio), a.seed, more)
    parts = chunks.join(split.select("pmid", "split"), "pmid")
    if a.scorer == "logistic":  # epochs read them again and again; the model reads ids alone
        parts = materialized(parts.drop("attention_mask", "token_type_ids"), "parts")
    part = lambda name: parts.where(F.col("split") == name).drop("split")
    config = {"run_id": run, "scorer": a.scorer, "max_length": a.max_length, "vocab_size": a.vocab_size, "type_vocab_size": a.type_vocab_size}
    history = []
    if a.scorer == "logistic":

        def keep(model: window_model.WindowModel) -> None:
            """The best model so far is always there in whole."""
            model.save(f"{out}/next_model")
            replaced(spark, f"{out}/next_model", f"{out}/best_model")

        model, history = window_model.fit(part("train"), part("validation"), config, settings, features=a.features, on_best=keep)
        score, config = model.score, model.config
    else:
        score, _ = _scorer(spark, a)
    sinks.write_json(f"{out}/run_config.json", {"schema_version": 1, "command": " ".join(sys.argv), "arguments": {k: v for k, v in vars(a).items() if k != "run"}, "versions": _versions(spark), "config": config, "model_selection": {"metric": "validation chunk loss", "tie_break": "validation article AUROC"}})
    sinks.write_json(f"{out}/training_history.json", {"epochs": history})
    validation = _scores(score, part("validation"))
    best = A.choose_threshold(A.checked(A.article_scores(validation).withColumn("threshold", F.lit(0.5))), a.threshold_objective).first()
    frozen, rows = _documents(validation, best.threshold)
    sinks.write_json(f"{out}/threshold.json", best.asDict() | {"run_id": run, "scorer": a.scorer, "aggregation": "mean", "best_epoch": config.get("best_epoch"), "selection_set": "internal_validation", "validation": frozen})
    sinks.write_ordered(rows, f"{out}/validation_predictions", ("pmid",))
    tested, rows = _documents(_scores(score, part("test")), best.threshold)
    sinks.write_ordered(rows, f"{out}/predictions", ("pmid",))
    sinks.write_json(f"{out}/internal_results.json", {"run_id": run, "best_epoch": config.get("best_epoch"), "threshold": best.threshold, "metrics": tested["article_metrics"], "score_summary": tested["score_summary"], "validation": frozen, "internal_test": tested, "elapsed_seconds": time.time() - began})


def evaluate(spark: SparkSession, a) -> None:
    """External files with a frozen scorer and threshold, which must be of one run; articles of the training manifest are
    an error unless allowed."""
    out, began = sinks.new_dir(a.output_dir), time.time()
    score, config = _scorer(spark, a)
    home = os.path.dirname(a.model_dir.rstrip("/")) if a.model_dir else None
    beside = lambda name: f"{home}/{name}" if home is not None and storage.exists(f"{home}/{name}") else None
    threshold, frozen = a.threshold, {}
    if threshold is None:
        path = a.threshold_file or beside("threshold.json")
        if path is None:
            raise ValueError("--threshold, --threshold-file or --model-dir is required")
        frozen = files.threshold_document(spark, path)
        threshold = release.check_threshold(frozen, config["run_id"] if "run_id" in config and frozen.get("run_id") is not None else None, "mean")
    chunks, stats = _load(spark, a, config)
    manifest, shared = a.training_manifest or beside("split_manifest.json"), []
    if manifest:
        overlap = cohorts.leakage(chunks, files.manifest_ids(spark, manifest))
        shared = [r.pmid for r in overlap.orderBy("pmid").collect()] if a.allow_overlap else [r.pmid for r in overlap.orderBy("pmid").limit(10).collect()]
        if shared and not a.allow_overlap:
            raise ValueError(f"external articles occur in the training manifest: {', '.join(shared)}")
    scored = _scores(score, chunks)
    found, rows = _documents(scored, threshold)
    sinks.write_ordered(rows, f"{out}/predictions", ("pmid",))
    if a.save_chunk_predictions:
        sinks.write_ordered(scored.select("pmid", "chunk_index", "label", "positive_probability", "sources"), f"{out}/chunk_predictions")
    sinks.write_json(f"{out}/external_results.json", {
        "schema_version": 1, "run_id": config.get("run_id"), "command": " ".join(sys.argv), "model_dir": a.model_dir, "threshold": threshold, "threshold_objective": frozen.get("objective"), "aggregation": "mean",
        "chunk_loss": found["chunk_loss"], "metrics": found["article_metrics"], "score_summary": found["score_summary"], "sources": [r.asDict() for r in stats.collect()], "input_files": _inputs(spark, [*a.positive, *a.negative]),
        "training_manifest": manifest, "training_overlap_pmids": shared, "elapsed_seconds": time.time() - began,
    })


def sample(spark: SparkSession, a) -> None:
    role = {"positive": [a.input], "negative": []} if a.label else {"positive": [], "negative": [a.input]}
    chunks = corpus.validated(corpus.with_defaults(files.labelled_chunks(spark, **role)), max_length=a.max_length)
    excluded = spark.createDataFrame([], "pmid string")
    if a.exclude_jsonl:
        excluded = excluded.union(files.json_ids(spark, a.exclude_jsonl))
    for path in a.exclude_manifest:
        excluded = excluded.union(files.manifest_ids(spark, path).select("pmid"))
    excluded = materialized(excluded, "excluded")
    chosen = materialized(cohorts.sample_checked(chunks.select("pmid"), excluded, a.n_articles, a.seed), "chosen")
    kept = cohorts.selected(chunks, chosen)
    sinks.write_jsonl(kept.drop("sources"), a.output)
    counts = cohorts.sample_counts(chunks, excluded, chunks, chosen).first().asDict()
    sinks.write_sampling_manifest(a.manifest_output or f"{a.output}.manifest.json", counts, kept.groupBy("pmid").agg(F.count("*").alias("n_chunks")), a.label, a.seed)


def analyze(spark: SparkSession, a) -> None:
    """Groups of article predictions with one frozen threshold: summaries, and all pairs in the order of the command."""
    out, specs = sinks.new_dir(a.output_dir), files.group_specs(a.group)
    rows = None
    for name, path in specs.items():
        own = files.predictions(spark, [path]).withColumn("group", F.lit(name))
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.cache()
    if audit.threshold_conflicts(rows).first():
        raise ValueError("all groups must use the same frozen threshold")
    options = (a.bootstrap_replicates, a.confidence_level, a.seed)
    drawn = {c: materialized(audit.resampled(rows, "group", c, a.bootstrap_replicates, a.seed), "replicates") for c in ("mean_positive_probability", "prediction")}  # groups and pairs read the same draws
    boot, rates = (audit.bootstrap(rows, "group", c, *options, drawn=own) for c, own in drawn.items())
    groups = audit.group_summary(rows, "group", confidence=a.confidence_level).join(boot.select("group", F.struct("mean_low", "mean_high", "variance_low", "variance_high").alias("bootstrap")), "group")
    groups = groups.join(rates.select("group", F.struct("mean_low", "mean_high").alias("rate_bootstrap")), "group").join(A.metrics(rows, ["group"]).select("group", F.struct("*").alias("metrics")), "group")
    levels = audit.group_quantiles(rows, "group").groupBy("group").agg(F.array_sort(F.collect_list(F.struct("level", "value"))).alias("quantiles"))
    groups = groups.join(levels, "group")
    names, key = list(specs), ["first_group", "second_group"]
    pairs = audit.pairwise(rows, "group", groups=names).join(audit.bootstrap_differences(rows, "group", "mean_positive_probability", *options, groups=names, drawn=drawn["mean_positive_probability"]), key)
    pairs = pairs.join(audit.bootstrap_differences(rows, "group", "prediction", *options, groups=names, drawn=drawn["prediction"]).toDF(*key, "rate_low", "rate_high"), key)
    groups, pairs = [r.asDict(True) for r in groups.collect()], [r.asDict(True) for r in pairs.collect()]
    groups.sort(key=lambda g: names.index(g["group"]))
    pairs.sort(key=lambda p: (names.index(p["first_group"]), names.index(p["second_group"])))
    sinks.write_json(f"{out}/analysis.json", {"schema_version": 1, "frozen_threshold": groups[0]["threshold"], "confidence_level": a.confidence_level, "bootstrap_replicates": a.bootstrap_replicates, "seed": a.seed, "input_files": {n: _inputs(spark, [p]) for n, p in specs.items()}, "groups": groups, "pairwise_comparisons": pairs})
    storage.write(f"{out}/analysis.md", sinks.report(groups, pairs, a.confidence_level, a.bootstrap_replicates, a.seed).encode())
    rows.unpersist()


def filter_overlap(spark: SparkSession, a) -> None:
    rows, excluded = files.json_lines(spark, [a.input]), files.json_ids(spark, a.exclude)
    sinks.write_lines(cohorts.without(rows, excluded).orderBy("path", "line").select("value"), a.output)
    if a.removed_ids:
        sinks.write_ids(cohorts.removed_ids(rows, excluded), a.removed_ids, numeric=False)


def export_ids(spark: SparkSession, a) -> None:
    sinks.write_ids(files.numeric_json_ids(spark, a.input, a.input_format), a.output)


def verify_release(spark: SparkSession, a) -> dict:
    """Recomputes hashes, counts, order, overlaps, relationships and the total of all id lists that a manifest names."""
    header = files.release_header(spark, f"{a.root}/manifest.json")
    if header["data_status"] != "verified-historical" or header["paper_cohort_verified"] is not False:
        raise ValueError("unexpected provenance of the release")
    listed = files.cohort_manifest(spark, f"{a.root}/manifest.json")
    if bad := release.provenance_violations(listed).limit(5).collect():
        raise ValueError(f"unexpected provenance: {bad}")
    rows, found = None, listed.collect()  # a row for each list
    for order, r in enumerate(found):
        path = f"{a.root}/{r.path}"
        if not storage.exists(path):
            raise FileNotFoundError(path)
        own = files.id_list(spark, [path]).select(F.lit(r.cohort).alias("cohort"), F.lit(order).alias("ord"), "line", "pmid")
        if files.fingerprints(spark, [path]).first().sha256 != r.sha256 or own.count() != r.unique_pmids:
            raise ValueError(f"{r.path}: hash or count differs from the manifest")
        rows = own if rows is None else rows.union(own)
    if bad := cohorts.list_violations(rows).limit(5).collect():
        raise ValueError(f"id lists are not numeric and ascending: {bad}")
    members = rows.select("pmid", "cohort").cache()
    computed = cohorts.overlap_matrix(members, rows.select("cohort", "ord").distinct()).withColumnRenamed("shared", "shared_pmids")
    recorded = files.csv_table(spark, f"{a.root}/overlap_counts.csv", "cohort_a string, cohort_b string, shared_pmids long")
    if diff := cohorts.table_differences(recorded, computed).limit(5).collect():
        raise ValueError(f"overlap table differs: {diff}")
    checks = release.relationships(members, {r.cohort for r in found})
    if checks and checks != header["checks"]:
        raise ValueError(f"relationship checks differ from the manifest: {checks}")
    distinct = members.select("pmid").distinct().count()
    if header["distinct"] is not None and distinct != header["distinct"]:
        raise ValueError(f"{distinct} distinct ids, the manifest says {header['distinct']}")
    members.unpersist()
    print(f"{len(found)} cohorts verified, {distinct} distinct ids")
    return {"cohorts": len(found), "distinct_pmids": distinct, "checks": checks}


def recover(spark: SparkSession, a) -> None:
    """Id lists from archived window files, which must be bit for bit what a manifest names, as must be the sorted lists made of them, and the sampling manifests
    that some come from; nothing is written unless all are. --archive holds the files by their source path."""
    out = sinks.new_dir(a.output_dir)
    listed = files.archive_manifest(spark, a.manifest)
    cohorts_, found, kept = listed.collect(), None, {}  # a row for each list
    expected = listed.select(F.col("path").alias("name"), F.col("source_bytes").alias("size"), F.col("source_git_blob_sha").alias("git_sha1"), F.col("source_rows").alias("rows"), F.col("unique_pmids").alias("ids"))
    staged = scratch(spark, "recovered")
    for r in cohorts_:
        path = f"{a.archive}/{r.source_path}"
        if not storage.exists(path):
            raise FileNotFoundError(path)
        rows = files.json_lines(spark, [path])
        files.meeting(rows, {"not a numeric id": ~F.col("pmid").rlike(cohorts.NUMERIC_ID)})
        counts = rows.agg(F.count("*").alias("rows"), F.countDistinct("pmid").alias("ids"))
        own = files.fingerprints(spark, [path]).select(F.lit(r.path).alias("name"), "size", "git_sha1", "sha256").crossJoin(counts)  # a row each
        found = own if found is None else found.union(own)
        kept[r.path] = f"{staged}/{len(kept)}.txt"
        sinks.write_id_file(rows.select("pmid"), kept[r.path])
    found = materialized(found, "archived")
    if bad := release.blob_violations(found, expected).collect():
        raise ValueError("; ".join(f"{r.name}: {r.rule} differs" for r in bad))
    hashes = {r.name: r.sha256 for r in found.collect()}
    for r in cohorts_:
        if r.pmid_file_sha256 is not None and _inputs(spark, [kept[r.path]])[0]["sha256"] != r.pmid_file_sha256:
            raise ValueError(f"{r.path}: the sorted ids differ from the manifest's")
        if r.sampled_path is None:
            continue
        path = f"{a.archive}/{r.sampled_path}"
        if r.sampled_blob_sha is not None and _inputs(spark, [path])[0]["git_sha1"] != r.sampled_blob_sha:
            raise ValueError(f"{r.path}: the sampling manifest differs from the one named")
        if (sha := files.sampled_output_hash(spark, path)) is not None and sha != hashes[r.path]:
            raise ValueError(f"{r.path}: the sampling manifest is of another file")
        if diff := release.sampled_differences(files.sampled_counts(spark, path), files.json_lines(spark, [f"{a.archive}/{r.source_path}"])).limit(5).collect():
            raise ValueError(f"{r.path}: sampled articles differ: {diff}")
    for name, path in kept.items():
        storage.copy(path, f"{out}/{name}")
    drop(spark, staged)


def fetch(spark: SparkSession, a, client=None) -> None:
    """Articles by id from a service: a request returns one XML document for a batch. Responses are kept as they come, a run that was interrupted goes on
    with --resume, and what is returned has to be exactly the ids that were asked for. client: a function from ids to XML instead of --email."""
    if client is None:
        if not getattr(a, "email", None):
            raise ValueError("no client: name a contact by --email, or pass client=, a function from ids to XML")
        client = service.http_client(a.endpoint, a.email, a.timeout)
    resumed = getattr(a, "resume", False)
    out = a.output_dir.rstrip("/") if resumed else sinks.new_dir(a.output_dir)
    ids = files.id_list(spark, [a.pmids])
    if bad := cohorts.list_violations(ids.withColumn("cohort", F.lit("ids"))).where("rule = 'not numeric'").limit(5).collect():
        raise ValueError(f"not numeric: lines {[r.line for r in bad]}")
    if ids.groupBy("pmid").count().where("count > 1").limit(1).collect() or ids.isEmpty():
        raise ValueError("the list must hold different ids")
    options = {k: getattr(a, k) for k in ("lanes", "pause", "retries") if hasattr(a, k)}
    responses = service.collected(f"{out}/requests", f"{out}/responses", markup.request_batches(ids, a.batch_size), client, **options)
    rows = markup.parse_articles(responses, a.label).withColumn("data_status", F.lit("reconstruction"))
    if diff := markup.returned_differences(ids, rows).limit(5).collect():
        raise ValueError(f"returned ids differ from those asked for: {diff}")
    if twice := rows.groupBy("pmid").count().where("count > 1").limit(5).collect():
        raise ValueError(f"ids returned twice: {', '.join(r.pmid for r in twice)}")
    sinks.write_ordered(rows, f"{out}/articles", ("pmid",))
    made = spark.read.schema(files.ARTICLE).json(f"{out}/articles")
    sinks.write_retrieval_manifest(f"{out}/retrieval_manifest.json", made, responses, ids.count(), getattr(a, "endpoint", None) or "client", time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()))


def demo(spark: SparkSession, a) -> None:
    """With --tables the flagship query; with --output-dir the whole workflow on made-up articles: preprocess, train, evaluate."""
    if a.tables:
        from .plans.queries import fairness_audit

        fairness_audit(spark, a.tables).orderBy("lang").show(truncate=False)
    if not a.output_dir:
        return
    out = sinks.new_dir(a.output_dir)
    words = ("red green blue square circle line".split(), "one two three four five six".split())
    for part, n in (("internal", 12), ("external", 4)):
        for label, role in ((0, "negative"), (1, "positive")):
            texts = [" ".join(words[label][(k + j * (k % 3 + 1)) % 6] for j in range(20 + 20 * (k % 3))) for k in range(n)]
            made = [json.dumps({"pmid": f"DEMO-{part}-{label}-{k}", "title": f"Shapes {k}", "abstract": own, "label": label, "data_status": "demo-only"}) for k, own in enumerate(texts)]
            storage.write(f"{out}/{part}_{role}.jsonl", "".join(f"{x}\n" for x in made).encode())
            main(["preprocess", "--input", f"{out}/{part}_{role}.jsonl", "--output", f"{out}/{part}_{role}", "--max-length", "32", "--overlap", "4", "--status", "demo-only"], spark)
    files_of = lambda part: ["--positive", f"{out}/{part}_positive", "--negative", f"{out}/{part}_negative", "--max-length", "32"]
    main(["train", *files_of("internal"), "--output-dir", f"{out}/run"], spark)
    main(["evaluate", *files_of("external"), "--model-dir", f"{out}/run/best_model", "--output-dir", f"{out}/external_test"], spark)


def _number(kind: type, low: float, high: float = float("inf"), open_low: bool = False, open_high: bool = False):
    """A parser of numbers between low and high."""

    def parse(text: str):
        value = kind(text)
        if not (low < value if open_low else low <= value) or not (value < high if open_high else value <= high):
            raise argparse.ArgumentTypeError(f"{text} is not {'above' if open_low else 'at least'} {low}" + (f" and {'below' if open_high else 'at most'} {high}" if high < float("inf") else ""))
        return value

    return parse


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veriscreen", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(f, *arguments: tuple) -> None:
        p = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        for name, options in arguments:
            p.add_argument(name, **options)
        p.set_defaults(run=f)

    need, many = {"required": True}, {"nargs": "*", "default": []}
    number = lambda kind, default: {"type": kind, "default": default}
    count, share, above = _number(int, 1), _number(float, 0, 1, open_high=True), _number(float, 0, open_low=True)
    roles = (("--positive", many), ("--negative", many), ("--max-length", number(count, 512)), ("--output-dir", need), ("--vocab-size", number(count, None)), ("--type-vocab-size", number(count, None)), ("--onnx-model", {}))
    command(preprocess, ("--input", {"nargs": "+", **need}), ("--output", need), ("--max-length", number(count, 512)), ("--overlap", number(_number(int, 0), 32)), ("--vocabulary", number(int, 30_000)), ("--vocabulary-file", {}), ("--status", {"choices": ("demo-only", "reconstruction")}))
    command(train, *roles, ("--train-ratio", number(above, 0.7)), ("--validation-ratio", number(above, 0.175)), ("--test-ratio", number(above, 0.125)), ("--seed", number(int, 42)), ("--scorer", {"choices": ("logistic", "surrogate", "onnx"), "default": "logistic"}), ("--epochs", number(count, 3)), ("--features", number(count, window_model.FEATURES)), ("--train-batch-size", number(count, 1024)), ("--gradient-accumulation-steps", number(count, 1)), ("--learning-rate", number(above, 0.05)), ("--weight-decay", number(_number(float, 0), 0.025)), ("--warmup-ratio", number(share, 0.15)), ("--scheduler-type", {"choices": ("linear", "cosine", "cosine_with_restarts"), "default": "cosine"}), ("--max-grad-norm", number(above, 1.0)), ("--threshold-objective", {"choices": A.OBJECTIVES, "default": "youden"}))
    command(evaluate, *roles, ("--threshold", number(_number(float, 0, 1), None)), ("--threshold-file", {}), ("--training-manifest", {}), ("--allow-overlap", {"action": "store_true"}), ("--model-dir", {}), ("--save-chunk-predictions", {"action": "store_true"}))
    command(sample, ("--input", need), ("--label", {"type": int, "choices": (0, 1), **need}), ("--n-articles", {"type": count, **need}), ("--output", need), ("--manifest-output", {}), ("--exclude-jsonl", many), ("--exclude-manifest", many), ("--seed", number(int, 42)), ("--max-length", number(count, 512)))
    command(analyze, ("--group", {"action": "append", **need}), ("--output-dir", need), ("--confidence-level", number(_number(float, 0, 1, open_low=True, open_high=True), 0.95)), ("--bootstrap-replicates", number(_number(int, 100), 10_000)), ("--seed", number(int, 42)))
    command(filter_overlap, ("--input", need), ("--exclude", {"nargs": "+", **need}), ("--output", need), ("--removed-ids", {}))
    command(export_ids, ("--input", {"nargs": "+", **need}), ("--output", need), ("--input-format", {"choices": ("jsonl", "sampling-manifest"), "default": "jsonl"}))
    command(verify_release, ("--root", need))
    command(recover, ("--archive", need), ("--manifest", need), ("--output-dir", need))
    command(fetch, ("--pmids", need), ("--label", {"type": int, "choices": (0, 1), **need}), ("--output-dir", need), ("--batch-size", number(_number(int, 1, 200), 100)), ("--email", {}), ("--endpoint", {"default": service.ENDPOINT}), ("--timeout", number(above, 60.0)), ("--pause", number(_number(float, 0), 0.4)), ("--retries", number(_number(int, 0), 3)), ("--lanes", number(count, 1)), ("--resume", {"action": "store_true"}))
    command(demo, ("--tables", {}), ("--output-dir", {}))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    a.run(spark or SparkSession.builder.appName("veriscreen").getOrCreate(), a)

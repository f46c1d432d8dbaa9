"""Queries through the commands: files are made from the provided tables, commands run on them, and what they wrote is read.
The commands' own documents are small and local to the driver; their tables go where Spark writes."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from .. import cli
from ..sources.scratch import scratch
from . import queries as Q
from .file_queries import _lines
from .queries import SQL_LABELLED, WORDS, query, rounded

_CHUNKS = f"""{SQL_LABELLED},
t0 AS (SELECT pmid, lang, source, label, len({WORDS}) AS n FROM (SELECT * EXCLUDE (text), source || chr(10) || chr(10) || text AS text FROM l)),
c0 AS (SELECT *, unnest(range(0, {Q._K}))::INTEGER AS chunk_index FROM t0),
s0 AS (SELECT *, ('0x' || substr(md5(pmid || ':' || chunk_index), 1, 8))::BIGINT::DOUBLE / 4294967295.0 AS p FROM c0),
a0 AS (SELECT pmid, any_value(label) AS label, any_value(lang) AS lang, count(*) AS n_chunks, avg(p) AS m FROM s0 GROUP BY pmid)"""
_SPLIT = f"sp0 AS ({Q._SPLIT} SELECT pmid, split FROM sp)"
_CUTS = Q._threshold_sql("youden").split(f"{Q.SQL_ARTICLES},", 1)[1]


def _folder(spark, name: str) -> str:
    """A new folder that both the driver's Python and Spark can write to."""
    path = scratch(spark, name)
    if "://" in path.replace("file://", ""):
        raise ValueError("commands write their documents to mounted folders")
    return "/" + path.removeprefix("file:").lstrip("/")


def _windows(spark, sf_dir) -> dict[int, str]:
    """Window files of both roles, made by the command from raw articles."""
    rows = Q.labelled(spark, sf_dir).select(F.col("pmid").cast("string").alias("pmid"), F.col("source").alias("title"), F.col("text").alias("abstract"), F.lit("reconstruction").alias("data_status"), "label")
    out = {}
    for label in (0, 1):
        out[label] = f"{_folder(spark, 'windows')}/chunks"
        cli.main(["preprocess", "--input", _lines(rows.where(F.col("label") == label), "raw"), "--output", _made(out[label]), "--max-length", str(Q.MAX_LENGTH), "--overlap", str(Q.OVERLAP), "--status", "reconstruction"], spark)
    return out


def _made(path: str) -> str:
    import os

    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


def _roles(windows: dict[int, str]) -> list[str]:
    return ["--positive", windows[1], "--negative", windows[0], "--max-length", str(Q.MAX_LENGTH)]


@query(f"WITH {_CHUNKS} SELECT pmid::VARCHAR AS pmid, chunk_index, label, least({Q.CAP}, n - chunk_index * {Q.STEP})::BIGINT + 2 AS n_ids FROM s0")
def command_preprocess(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    rows = spark.read.schema("pmid string, chunk_index int, label int, input_ids array<int>").json(list(windows.values()))
    return rows.select("pmid", "chunk_index", "label", F.size("input_ids").cast("long").alias("n_ids"))


_METRICS = "count(*) AS n_articles, count(*) FILTER (label = 1 AND m >= t) AS tp, count(*) FILTER (label = 0 AND m < t) AS tn, count(*) FILTER (label = 0 AND m >= t) AS fp, count(*) FILTER (label = 1 AND m < t) AS fn, round(t, 6) AS threshold"


def _trained(spark, windows) -> str:
    out = _folder(spark, "run")
    cli.main(["train", *_roles(windows), "--output-dir", out, "--scorer", "surrogate", "--train-ratio", "0.8", "--validation-ratio", "0.1", "--test-ratio", "0.1"], spark)
    return out


def _counts(spark, found: dict, threshold: float):
    row = (*(found[c] for c in ("n_articles", "tp", "tn", "fp", "fn")), round(threshold, 6))
    return spark.createDataFrame([row], "n_articles long, tp long, tn long, fp long, fn long, threshold double")


_THRESHOLD = f"""a AS (SELECT a0.* FROM a0 JOIN sp0 USING (pmid) WHERE split = 'validation'),
{_CUTS.split("SELECT round(s, 6) AS threshold", 1)[0].rstrip().lstrip()},
best AS (SELECT s AS t FROM y ORDER BY youden DESC, spec DESC, sens DESC, s DESC LIMIT 1)"""


@query(f"WITH {_CHUNKS}, {_SPLIT}, {_THRESHOLD} SELECT {_METRICS} FROM a0 JOIN sp0 USING (pmid), best WHERE split = 'test' GROUP BY t")
def command_train(spark, sf_dir):
    """Split, a threshold on the validation part, counts of the test part with it frozen."""
    with open(f"{_trained(spark, _windows(spark, sf_dir))}/internal_results.json", encoding="utf-8") as file:
        found = json.load(file)
    return _counts(spark, found["metrics"], found["threshold"])


@query(f"WITH {_CHUNKS}, {_SPLIT}, {_THRESHOLD} SELECT {_METRICS} FROM a0, best GROUP BY t")
def command_evaluate(spark, sf_dir):
    """All articles with the threshold of a training run, whose articles are allowed to be among them."""
    windows = _windows(spark, sf_dir)
    run, out = _trained(spark, windows), _folder(spark, "external")
    cli.main(["evaluate", *_roles(windows), "--output-dir", out, "--threshold-file", f"{run}/threshold.json", "--training-manifest", f"{run}/split_manifest.json", "--allow-overlap"], spark)
    with open(f"{out}/external_results.json", encoding="utf-8") as file:
        found = json.load(file)
    return _counts(spark, found["metrics"], found["threshold"])


@query(f"WITH {SQL_LABELLED}, e AS (SELECT DISTINCT pmid FROM l WHERE label = 1 AND toxic = 0) SELECT pmid::VARCHAR AS pmid FROM e ORDER BY sha256('42' || chr(0) || pmid), pmid::VARCHAR LIMIT 30")
def command_sample(spark, sf_dir):
    """Thirty articles of the positive role without those that an exclusion file names."""
    windows, out = _windows(spark, sf_dir), _folder(spark, "sample")
    toxic = Q.labelled(spark, sf_dir).where("toxic = 1").select(F.col("pmid").cast("string").alias("pmid"))
    cli.main(["sample", "--input", windows[1], "--label", "1", "--n-articles", "30", "--output", f"{_made(out + '/x')}", "--exclude-jsonl", _lines(toxic, "excluded"), "--max-length", str(Q.MAX_LENGTH)], spark)
    return spark.read.schema("pmid string").json(f"{out}/x").distinct()


@query(f"WITH {_CHUNKS} SELECT pmid::VARCHAR AS pmid, count(*) AS n_chunks, label FROM s0 WHERE label = 0 AND pmid % 3 <> 1 GROUP BY pmid, label")
def command_filter_overlap(spark, sf_dir):
    windows, out = _windows(spark, sf_dir), _folder(spark, "filtered")
    some = Q.labelled(spark, sf_dir).where("pmid % 3 = 1").select(F.col("pmid").cast("string").alias("pmid"))
    cli.main(["filter-overlap", "--input", windows[0], "--exclude", _lines(some, "excluded"), "--output", f"{_made(out + '/x')}"], spark)
    return spark.read.schema("pmid string, label int").json(f"{out}/x").groupBy("pmid", "label").agg(F.count("*").alias("n_chunks"))


@query(f"WITH {SQL_LABELLED} SELECT DISTINCT pmid::VARCHAR AS pmid FROM l WHERE label = 1 AND pmid > 0")
def command_export_ids(spark, sf_dir):
    out = _folder(spark, "export")
    rows = Q.labelled(spark, sf_dir).where("label = 1 and pmid > 0").select("pmid", "lang")
    cli.main(["export-ids", "--input", _lines(rows, "ids"), "--output", f"{_made(out + '/x')}"], spark)
    return spark.read.text(f"{out}/x").withColumnRenamed("value", "pmid")


@query(f"WITH {_CHUNKS}, g AS (SELECT lang, avg(m) AS m, avg((m >= 0.5)::INTEGER) AS r, count(*) AS n FROM a0 WHERE lang IN ('en', 'de', 'fr') GROUP BY lang), o AS (SELECT *, instr('fr,en,de', lang) AS k FROM g) SELECT x.lang AS first_group, y.lang AS second_group, x.n AS n_first, y.n AS n_second, round(x.m - y.m, 6) AS mean_difference, round(x.r - y.r, 6) AS rate_difference FROM o x JOIN o y ON x.k < y.k")
def command_analyze(spark, sf_dir):
    """Three groups of article predictions, compared in the order of the command."""
    windows, out, predicted = _windows(spark, sf_dir), _folder(spark, "analysis"), _folder(spark, "predicted")
    cli.main(["evaluate", *_roles(windows), "--output-dir", predicted, "--threshold", "0.5"], spark)
    lang = Q.labelled(spark, sf_dir).select(F.col("pmid").cast("string").alias("pmid"), "lang")
    rows = spark.read.schema("pmid string, label int, n_chunks int, mean_positive_probability double, prediction int, threshold double, sources array<string>").json(f"{predicted}/predictions").join(lang, "pmid")
    groups = [x for g in ("fr", "en", "de") for x in ("--group", f"{g}={_lines(rows.where(F.col('lang') == g).drop('lang'), g)}")]
    cli.main(["analyze", *groups, "--output-dir", out, "--bootstrap-replicates", "100"], spark)
    with open(f"{out}/analysis.json", encoding="utf-8") as file:
        found = json.load(file)
    n = {g["group"]: g["n_articles"] for g in found["groups"]}
    pairs = [(p["first_group"], p["second_group"], n[p["first_group"]], n[p["second_group"]], p["mean_difference"], p["rate_difference"]) for p in found["pairwise_comparisons"]]
    return rounded(spark.createDataFrame(pairs, "first_group string, second_group string, n_first long, n_second long, mean_difference double, rate_difference double"))

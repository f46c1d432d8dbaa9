"""Writers of tables, JSON documents, id lists and reports; none overwrites."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import documents, storage
from .scratch import drop, scratch
from .storage import new_dir

__all__ = ["fmt", "new_dir", "preprocess_manifest", "report", "retrieval_manifest", "write_id_file", "write_ids", "write_json", "write_jsonl", "write_lines", "write_ordered", "write_retrieval_manifest", "write_sampling_manifest", "write_split_manifest"]


def write_json(path: str, payload: dict) -> None:
    """A new JSON document: UTF-8, sets as sorted lists, no NaN."""

    def plain(x):
        if isinstance(x, (set, frozenset)):
            return sorted(x)
        if hasattr(x, "asDict"):
            return x.asDict(True)
        raise TypeError(type(x).__name__)

    storage.write(path, (json.dumps(payload, ensure_ascii=False, indent=2, allow_nan=False, default=plain) + "\n").encode())


def write_jsonl(rows: DataFrame, path: str) -> None:
    """A folder of JSON lines, null fields included; Spark refuses a folder that exists, and commits all files at once."""
    rows.write.option("ignoreNullFields", "false").json(path)


def write_ordered(rows: DataFrame, path: str, order: tuple[str, ...] = ("pmid", "chunk_index")) -> None:
    """write_jsonl with rows in this order, by ranges: within files and from one file to the next."""
    write_jsonl(rows.orderBy(*order), path)


def write_lines(values: DataFrame, path: str) -> None:
    """A folder of text files of the only column."""
    values.write.text(path)


def write_ids(ids: DataFrame, path: str, numeric: bool = True, key: str = "pmid") -> None:
    """A folder with a sorted id list: by number, or by code points."""
    order = [F.length(key), F.col(key)] if numeric else [F.col(key)]
    ids.select(F.col(key).cast("string")).distinct().orderBy(*order).write.text(path)


def write_id_file(ids: DataFrame, path: str, key: str = "pmid") -> None:
    """write_ids as one file with a line feed behind each id: parts are sorted by tasks, and copied one behind the other."""
    folder = scratch(ids.sparkSession, "ids")
    write_ids(ids, folder, key=key)
    storage.stitch(path, [b"", b""], [folder])
    drop(ids.sparkSession, folder)


def write_split_manifest(path: str, split: DataFrame, ratios: tuple[float, float, float], seed: int, more: dict) -> None:
    """A manifest of split(pmid, label, split, n_chunks, sources), with the fields of `more`. Articles are written by tasks; the driver sees sums."""
    sums = split.groupBy("split").agg(F.count("*").alias("articles"), F.sum("n_chunks").alias("chunks"), F.count_if(F.col("label") == 1).alias("positive"), F.count_if(F.col("label") == 0).alias("negative"))
    summary = {r.split: r.asDict() for r in sums.collect()}
    totals = {f"deduplicated_total_{k}": sum(x[k] for x in summary.values()) for k in ("articles", "chunks")}
    documents.write(path, {"schema_version": 1, "ratios": list(ratios), "seed": seed, "summary": summary, **totals, **more}, {"articles": (split.select("pmid", "label", "split", "n_chunks", "sources"), ["pmid"])})


def write_sampling_manifest(path: str, counts: dict, sampled: DataFrame, label: int, seed: int) -> None:
    """A manifest of sampled(pmid, n_chunks), written as the one of a split."""
    head = {"schema_version": 1, "sampling_unit": "article/pmid", "forced_label": label, "seed": seed, "sampling_algorithm": "first N by sha256 of seed, zero character and id; ties by id", **counts}
    documents.write(path, head, {"sampled_pmids": (sampled.select("pmid", "n_chunks"), ["pmid"])})


def fmt(value: float | None, digits: int = 6) -> str:
    return "NA" if value is None else f"{value:.{digits}f}"


def report(groups: list[dict], comparisons: list[dict], confidence: float, replicates: int, seed: int) -> str:
    """The audit as Markdown: a table of groups and one of pairs."""
    percent = f"{100 * confidence:g}%"
    out = ["# Group comparison", "", f"Intervals: {percent}; bootstrap replicates: {replicates}; seed: {seed}.", "", "| group | articles | mean score | mean interval | positive rate | rate interval |", "|---|---:|---:|---|---:|---|"]
    out += [f"| {g['group']} | {g['n_articles']} | {fmt(g['mean'])} | {fmt(g['mean_low'])} to {fmt(g['mean_high'])} | {fmt(g['predicted_positive_rate'])} | {fmt(g['rate_low'])} to {fmt(g['rate_high'])} |" for g in groups]
    out += ["", "| first | second | mean difference | interval | rate difference | rate interval | Cohen's d |", "|---|---|---:|---|---:|---|---:|"]
    out += [f"| {c['first_group']} | {c['second_group']} | {fmt(c['mean_difference'])} | {fmt(c.get('low'))} to {fmt(c.get('high'))} | {fmt(c['rate_difference'])} | {fmt(c.get('rate_low'))} to {fmt(c.get('rate_high'))} | {fmt(c['cohens_d'])} |" for c in comparisons]
    out += ["", "| group | sample variance of scores | sample variance of decisions |", "|---|---:|---:|"]
    out += [f"| {g['group']} | {fmt(g.get('sample_variance'))} | {fmt(g.get('bernoulli_sample_variance'))} |" for g in groups]
    out += ["", "Differences are first minus second. Intervals of means and differences are bootstrap percentiles or normal, those of rates Wilson. A difference between groups of articles is not by itself one between populations of authors."]
    return "\n".join(out) + "\n"


def preprocess_manifest(articles: DataFrame, chunks: DataFrame, parameters: dict, files: dict[str, str]) -> dict:
    """Counts, parameters and file hashes of a conversion to windows."""
    return {"schema_version": 1, "articles": articles.count(), "chunks": chunks.count(), "parameters": parameters, "tokenizer_files": files}


def _retrieval(articles: DataFrame, requested: int, endpoint: str, time: str) -> dict:
    return {"schema_version": 1, "data_status": "reconstruction", "endpoint": endpoint, "retrieved_at": time, "requested": requested, "retrieved": articles.count()}


def _without_abstract(articles: DataFrame) -> tuple[DataFrame, list]:
    return articles.where("abstract = ''").select(F.col("pmid").alias("value")), [F.length("value"), "value"]


def retrieval_manifest(articles: DataFrame, requested: int, endpoint: str, time: str, hashes: dict[str, str]) -> dict:
    """The manifest of a small retrieval: its ids without an abstract come to the driver."""
    rows, order = _without_abstract(articles)
    return _retrieval(articles, requested, endpoint, time) | {"sha256": hashes, "missing_abstracts": [r.value for r in rows.orderBy(*order).collect()]}


def write_retrieval_manifest(path: str, articles: DataFrame, responses: DataFrame, requested: int, endpoint: str, time: str) -> None:
    """What a retrieval asked for and got: the hash of each response(batch, attempts, xml), and the ids that have no abstract. Both lists are written by tasks."""
    raw = responses.select("batch", "attempts", F.sha2("xml", 256).alias("sha256"))
    documents.write(path, _retrieval(articles, requested, endpoint, time), {"raw_xml": (raw, ["batch"]), "missing_abstracts": _without_abstract(articles)})

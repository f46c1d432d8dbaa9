"""Readers of line-wise JSON, identifier lists, JSON documents and tables; strict, with line numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TEXT, clean_id
from ..operators.cohorts import NUMERIC_ID
from . import documents, storage
from .scratch import materialized

IDS = T.ArrayType(T.IntegerType())
CHUNK = T.StructType([T.StructField("pmid", T.StringType()), T.StructField("chunk_index", T.IntegerType()), T.StructField("label", T.IntegerType()), *(T.StructField(c, IDS) for c in ("input_ids", "attention_mask", "token_type_ids"))])
ARTICLE = T.StructType([*(T.StructField(c, T.StringType()) for c in ("pmid", "title", "abstract", "data_status")), T.StructField("label", T.IntegerType())])
PREDICTION = T.StructType([T.StructField("pmid", T.StringType()), T.StructField("label", T.IntegerType()), T.StructField("n_chunks", T.IntegerType()), T.StructField("mean_positive_probability", T.DoubleType()), T.StructField("prediction", T.IntegerType()), T.StructField("threshold", T.DoubleType()), T.StructField("sources", T.ArrayType(T.StringType()))])


class InvalidInput(ValueError):
    """Input that a reader rejects; the message names the first places in order of file and line."""


def numbered_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, line, value) of all lines that are not blank. Line numbers count all lines of a file: the lines of a split
    are numbered by themselves, and only the counts of the splits before are added."""
    rows = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), "value")
    blocks = rows.groupBy("path", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    from pyspark.sql import Window

    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    out = rows.join(F.broadcast(blocks), ["path", "_block"]).withColumn("line", F.col("_id") - F.col("_first") + F.col("_before") + 1)  # a row a split
    value = F.when(F.startswith("value", F.lit("\ufeff")), F.substring("value", 2, 2**31 - 1)).otherwise(F.col("value"))
    return out.select("path", "line", value.alias("value")).where(F.trim("value") != "")


def parsed(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """lines with the columns of schema, and `valid`: whether the line is one JSON object with fields of these types.
    true is no number, and a number with a point is no integer."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    out = lines.withColumn("_row", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    valid = F.col("_row").isNotNull() & F.col("_row._corrupt").isNull() & F.ltrim("value").startswith("{")
    return out.select("path", "line", "value", *(F.col("_row")[f.name].alias(f.name) for f in schema.fields), F.coalesce(valid, F.lit(False)).alias("valid"))


def strict(rows: DataFrame, rules: dict[str, Column] | None = None) -> DataFrame:
    """rows as a table, or InvalidInput with the first 20 lines that are not valid or meet a rule's condition. The input is read and parsed once: its rows are
    written to the shared folder, and the check and all that follows read them there."""
    return meeting(materialized(rows, "lines"), {"invalid JSON": ~F.col("valid"), **(rules or {})})


def meeting(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rows, or InvalidInput with the first 20 of rows(path, line, ...) that meet a rule's condition."""
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(k)) for k, c in rules.items())))
    bad = rows.select("path", "line", F.element_at(F.concat(found, F.array(F.lit(""))), 1).alias("rule")).where("rule <> ''")
    if first := bad.orderBy("path", "line").limit(20).collect():
        raise InvalidInput("; ".join(f"{r.path}:{r.line}: {r.rule}" for r in first))
    return rows


def role_paths(positive: Sequence[str], negative: Sequence[str]) -> list[tuple[str, int]]:
    """(path, label): each occurs once over both roles, and exists, in whatever file system; patterns are left to Spark."""
    out = [(path, label) for label, paths in ((1, positive), (0, negative)) for path in paths]
    if not out:
        raise InvalidInput("at least one input file is required")
    if gone := storage.missing(p for p, _ in out):
        raise FileNotFoundError(gone[0])
    if len({storage.qualified(p) for p, _ in out}) < len(out):
        raise InvalidInput("a file may occur only once over both roles")
    return out


def labelled_chunks(spark: SparkSession, positive: Sequence[str] = (), negative: Sequence[str] = ()) -> DataFrame:
    """Windows of many files: (path, line, pmid, chunk_index, label by the file's role, original_label, arrays)."""
    out = None
    for label in (1, 0):
        paths = [p for p, own in role_paths(positive, negative) if own == label]
        if paths:
            rows = strict(parsed(numbered_lines(spark, paths), CHUNK).drop("value").withColumn("pmid", clean_id(F.col("pmid")))).withColumn("original_label", F.col("label")).withColumn("label", F.lit(label))
            out = rows if out is None else out.unionByName(rows)
    return out.select("path", "line", "pmid", "chunk_index", "label", "original_label", "input_ids", "attention_mask", "token_type_ids")


def json_ids(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Distinct trimmed pmids of JSON lines; a missing or empty one is an error."""
    rows = parsed(numbered_lines(spark, paths), T.StructType([T.StructField("pmid", T.StringType())])).drop("value").withColumn("pmid", clean_id(F.col("pmid")))
    return strict(rows, {"missing or empty pmid": F.coalesce(F.col("pmid"), F.lit("")) == ""}).select("pmid").distinct()


def json_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, line, value, pmid): the objects as they stand, with their ids."""
    rows = parsed(numbered_lines(spark, paths), T.StructType([T.StructField("pmid", T.StringType())])).withColumn("pmid", clean_id(F.col("pmid")))
    return strict(rows, {"missing or empty pmid": F.coalesce(F.col("pmid"), F.lit("")) == ""}).drop("valid")


def numeric_json_ids(spark: SparkSession, paths: Sequence[str], input_format: str = "jsonl") -> DataFrame:
    """Distinct ids, all positive numbers, of JSON lines or of sampling manifests, which must hold as many different ids as
    they say."""
    if input_format == "jsonl":
        rows = json_lines(spark, paths)
        meeting(rows, {"not a numeric id": ~F.col("pmid").rlike(NUMERIC_ID)})
        return rows.select("pmid").distinct()
    if input_format != "sampling-manifest":
        raise ValueError(f"unknown input format {input_format!r}")
    out = None
    for path in paths:
        ids, outlines = documents.array(spark, path, "sampled_pmids", "pmid string")
        claimed = [x.get("sampled_articles") for x in outlines.values()]
        own = ids.agg(F.count("*").alias("n"), F.countDistinct("pmid").alias("ids"), F.count_if(~F.coalesce(F.col("pmid").rlike(NUMERIC_ID), F.lit(False))).alias("bad")).first()
        if own.bad or own.n != own.ids or any(not isinstance(x, int) or isinstance(x, bool) for x in claimed) or sum(claimed) != own.n:
            raise InvalidInput("inconsistent sampling manifest")
        out = ids.select("pmid") if out is None else out.union(ids.select("pmid"))
    return out.distinct()


def raw_articles(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Raw articles: a status with its form of id, a label of 0 or 1, text, and no id twice."""
    rows = parsed(numbered_lines(spark, paths), ARTICLE)
    demo = F.col("data_status") == "demo-only"
    form = F.when(demo, F.col("pmid").startswith("DEMO-")).otherwise(F.col("pmid").rlike("^[0-9]+\\z"))
    rows = strict(rows.drop("value"), {"id does not fit data_status": ~F.coalesce(form, F.lit(False)), "label": ~F.col("label").isin(0, 1), "no text": ~F.concat("title", "abstract").rlike(TEXT)})
    if twice := rows.groupBy("pmid").count().where("count > 1").limit(5).collect():
        raise InvalidInput("duplicate pmid " + ", ".join(r.pmid for r in twice))
    return rows.select("pmid", "title", "abstract", "data_status", "label")


def predictions(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Article predictions: all columns in range, decisions as the threshold says, ids once, at least one row."""
    rows = parsed(numbered_lines(spark, paths), PREDICTION)
    p, t = F.col("mean_positive_probability"), F.col("threshold")
    rows = strict(rows.drop("value"), {
        "missing pmid": F.coalesce(F.col("pmid"), F.lit("")) == "", "label": ~F.col("label").isin(0, 1), "prediction": ~F.col("prediction").isin(0, 1), "n_chunks": F.col("n_chunks") < 1,
        "probability": F.isnan(p) | (p < 0) | (p > 1), "threshold": F.isnan(t) | (t < 0) | (t > 1), "prediction is not score >= threshold": F.col("prediction") != (p >= t).cast("int"),
    })
    if rows.isEmpty():
        raise InvalidInput("no predictions")
    if twice := rows.groupBy("pmid").count().where("count > 1").limit(5).collect():
        raise InvalidInput("duplicate pmid " + ", ".join(r.pmid for r in twice))
    return rows.drop("path", "line", "valid")


def id_list(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, line, pmid) of text files with an id a line."""
    return numbered_lines(spark, paths).withColumnRenamed("value", "pmid")


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def manifest_ids(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a split manifest's articles, with their split."""
    return documents.array(spark, path, "articles", "pmid string, label int, split string, n_chunks long")[0].drop("path")


def threshold(spark: SparkSession, path: str) -> float:
    """The threshold of a threshold document; it must lie in [0, 1]."""
    row = spark.read.schema("threshold double").json(path, multiLine=True).first()
    if row is None or row.threshold is None or not 0 <= row.threshold <= 1:
        raise InvalidInput(f"{path}: no threshold between 0 and 1")
    return row.threshold


def threshold_document(spark: SparkSession, path: str) -> dict:
    """A threshold document: threshold, objective, run_id, aggregation, what is missing as None."""
    row = spark.read.schema("threshold double, objective string, run_id string, aggregation string").json(path, multiLine=True).first()
    if row is None or row.threshold is None:
        raise InvalidInput(f"{path}: no threshold")
    return {k: v for k, v in row.asDict().items() if v is not None}


def release_header(spark: SparkSession, path: str) -> dict:
    """Of a release manifest: data_status, paper_cohort_verified, the total of distinct ids, recorded checks."""
    row = spark.read.schema("data_status string, paper_cohort_verified boolean, distinct_pmids_across_all_lists long, checks map<string,string>").json(path, multiLine=True).first()
    checks = {k: {"true": True, "false": False}.get(v, None if v is None else int(v) if v.isdigit() else v) for k, v in (row.checks or {}).items()}
    return {"data_status": row.data_status, "paper_cohort_verified": row.paper_cohort_verified, "distinct": row.distinct_pmids_across_all_lists, "checks": checks}


def archive_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, source_path, source_bytes, source_rows, source_git_blob_sha, unique_pmids, pmid_file_sha256, sampled_path, sampled_blob_sha) of a cohort manifest."""
    schema = "cohorts array<struct<path:string,source_path:string,source_bytes:long,source_rows:long,source_git_blob_sha:string,unique_pmids:long,pmid_file_sha256:string,sampling_evidence:struct<source_path:string,source_git_blob_sha:string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.inline("cohorts"))
    return rows.withColumns({"sampled_path": F.col("sampling_evidence.source_path"), "sampled_blob_sha": F.col("sampling_evidence.source_git_blob_sha")}).drop("sampling_evidence")


def sampled_output_hash(spark: SparkSession, path: str) -> str | None:
    """The hash that a sampling manifest gives of the file it is about."""
    row = spark.read.schema("output struct<sha256:string>").json(path, multiLine=True).first()
    return row.output.sha256 if row and row.output else None


def sampled_counts(spark: SparkSession, path: str) -> DataFrame:
    """(pmid, n_chunks) of a sampling manifest."""
    return documents.array(spark, path, "sampled_pmids", "pmid string, n_chunks long")[0].drop("path")


def cohort_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(cohort, path, unique_pmids, sha256, data_status, verified) of a cohort manifest."""
    schema = "cohorts array<struct<cohort_id:string,path:string,unique_pmids:long,pmid_file_sha256:string,data_status:string,paper_cohort_verified:boolean>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.inline("cohorts")).toDF("cohort", "path", "unique_pmids", "sha256", "data_status", "verified")


def group_specs(specs: Sequence[str]) -> dict[str, str]:
    """NAME=PATH arguments; names are not empty and different."""
    out: dict[str, str] = {}
    for spec in specs:
        name, found, path = spec.partition("=")
        if not found or not name.strip() or not path or name.strip() in out:
            raise InvalidInput(f"expected NAME=PATH with a new name, got {spec!r}")
        out[name.strip()] = path
    if not out:
        raise InvalidInput("at least one group is required")
    return out


_PACKED = ("gz", "bz2", "zst", "zstd", "lz4", "snappy", "deflate", "xz")  # files that the text reader would unpack
_MARK = b"\xef\xbb\xbf"  # which the text reader leaves out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, sha256, git_sha1) of the lines of each file, which come in order with a line feed behind each. Whether a file began with a byte order mark and ended with a line
    feed follows from its size."""
    out = []
    at, size, seen, states = None, 0, 0, []

    def closed() -> tuple:
        more = size - seen
        if more not in (0, 1, len(_MARK), len(_MARK) + 1):
            raise ValueError(f"{at}: {size} bytes, of which {seen} were read")
        big, git = states[more >= len(_MARK)]
        if more % len(_MARK):
            big.update(b"\n")
            git.update(b"\n")
        return at, big.hexdigest(), git.hexdigest()

    for batch in batches:
        runs, lines = pc.run_end_encode(batch.column(0)), batch.column(2)
        offsets = np.frombuffer(lines.buffers()[1], np.int64 if pa.types.is_large_binary(lines.type) else np.int32)[lines.offset :]
        start = 0
        for path, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
            raw = memoryview(lines.buffers()[2])[offsets[start] : offsets[end] - 1]  # the last line feed waits
            if path != at:
                if at is not None:
                    out.append(closed())
                at, size, seen = path, batch.column(1)[start].as_py(), len(raw)
                states = [(hashlib.sha256(own), hashlib.sha1(b"blob %d\0" % size + own)) for own in (b"", _MARK)]
                pieces = (raw,)
            else:
                seen += len(raw) + 1
                pieces = (b"\n", raw)
            for pair in states:
                for state in pair:
                    for piece in pieces:
                        state.update(piece)
            start = end
    if at is not None:
        out.append(closed())
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string()) for k in range(3)], ["path", "sha256", "git_sha1"])


_WHOLE = 1 << 45  # bytes of a file that is not cut, at most


def _uncut(spark: SparkSession) -> SparkSession:
    """A session beside this one, in which the reader of lines cuts no file, and deals each to a partition of its own."""
    out = spark.newSession()
    for name, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(name):
            out.conf.set(name, value)
    for name in ("maxPartitionBytes", "openCostInBytes"):
        out.conf.set(f"spark.sql.files.{name}", _WHOLE)
    return out


def fingerprints(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, size, sha256, git_sha1) of whole files; the last as a version store names a blob. A file's lines pass in order through one task, which carries
    the hash states on: a hash is sequential, so files are read uncut and nothing is shuffled or sorted, and no file is a cell. Packed files are read as cells
    (2 GB at most); empty files have no row, as Spark leaves them out."""
    listed = spark.read.format("binaryFile").load(list(paths)).select("path", F.col("_metadata.file_path").alias("file"), F.col("length").alias("size"))
    packed = rf"\.({'|'.join(_PACKED)})$"
    lines = _uncut(spark).read.option("lineSep", "\n").text(list(paths)).where(~F.col("_metadata.file_path").rlike(packed))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.concat(F.col("value").cast("binary"), F.lit(b"\n")).alias("value"))
    found = lines.mapInArrow(_hashed, "file string, sha256 string, git_sha1 string")
    mark = {"sha256": hashlib.sha256(_MARK).hexdigest(), "git_sha1": hashlib.sha1(b"blob 3\0" + _MARK).hexdigest()}  # has no line
    plain = listed.where(~F.col("path").rlike(packed)).join(found, "file", "left").select("path", "size", *(F.coalesce(c, F.when(F.col("size") == len(_MARK), mark[c])).alias(c) for c in mark))
    return plain.union(_cells(spark, paths))


def _cells(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Fingerprints of packed files alone: others are not even listed, as their contents would be read before a condition."""
    blob = F.sha1(F.concat(F.lit("blob ").cast("binary"), F.col("length").cast("string").cast("binary"), F.lit(b"\x00"), F.col("content")))
    found = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(_PACKED)}}}").load(list(paths))
    return found.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), blob.alias("git_sha1"))

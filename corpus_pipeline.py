"""A training-corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; run() writes it as Parquet in the
shared folder and reads it again as the next one's docs. All but the last return the columns of docs.

toxicity: rows predicted as toxic go. Labels come from the labels table, without its held-out fold.
near_duplicates: of each group that n-gram Jaccard links connect, one row with the smallest doc_id stays; rows without
    words link with nothing and stay.
decontamination: rows that hold three quarters or more of a benchmark item's 5-word shingles go.
mixing: sources are brought to temperature weights by repeating rows; every row stays at least once.
token_files: the rows as token-ID files in ascending doc_id order; the result has a row for each written document.

Null texts count as empty and pass; empty tables pass through; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veriscreen.llm import decontam, jaccard, mixing, token_files, toxicity
from veriscreen.llm.queries import table, tokenizer_path
from veriscreen.llm.shared import drop, scratch


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep_below(docs, model)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_first(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"), short_runs=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken(docs).select("all.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_files.digest_token_files(spark, token_files.write_token_files(docs, tokenizer_path(), runs=True, compression="snappy"))


STAGES = [
    ("toxicity", keep_civil),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", keep_uncontaminated),
    ("mixing", mix_sources),
    ("token_files", write_tokens),
]

#: The learned lexicon, and the tokenizer, are beyond SQL: tests compare each stage with a brute-force one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    before = None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            drop(spark, before)  # only the next stage reads it
        before = f"{folder}/{name}"
    return docs

"""Window files of labelled articles: validation, label roles, merging of duplicates, load statistics."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialized

KEY = ("pmid", "chunk_index")
PAYLOAD = ("label", "input_ids", "attention_mask", "token_type_ids")


def with_defaults(rows: DataFrame) -> DataFrame:
    """token_type_ids of zeros where they are missing."""
    return rows.withColumn("token_type_ids", F.coalesce("token_type_ids", F.array_repeat(F.lit(0), F.size("input_ids"))))


def row_rules(max_length: int = 512, vocabulary: int | None = None, types: int | None = None) -> dict[str, Column]:
    """Name to condition of each violation that one row shows by itself; conditions are never null."""
    if max_length < 1:
        raise ValueError("max_length must be positive")
    ids, mask, kinds = F.col("input_ids"), F.col("attention_mask"), F.col("token_type_ids")
    sizes = [F.coalesce(F.size(c), F.lit(0)) for c in (ids, mask, kinds)]
    rules = {
        "missing_pmid": F.col("pmid").isNull(),
        "empty_pmid": F.col("pmid") == "",
        "chunk_index": F.col("chunk_index").isNull() | (F.col("chunk_index") < 0),
        "empty_array": (sizes[0] <= 0) | (sizes[1] <= 0) | (sizes[2] <= 0),
        "unequal_lengths": (sizes[0] != sizes[1]) | (sizes[0] != sizes[2]),
        "too_long": sizes[0] > max_length,
        "negative_id": F.array_min(ids) < 0,
        "mask_values": (F.array_min(mask) < 0) | (F.array_max(mask) > 1),
        "mask_all_zero": F.array_max(mask) == 0,
        "negative_type": F.array_min(kinds) < 0,
    }
    if vocabulary is not None:
        rules["id_beyond_vocabulary"] = F.array_max(ids) >= vocabulary
    if types is not None:
        rules["type_beyond_vocabulary"] = F.array_max(kinds) >= types
    return {k: F.coalesce(v, F.lit(False)) for k, v in rules.items()}


def row_violations(rows: DataFrame, **limits) -> DataFrame:
    """(rule, path, line, pmid) of all rows and rules, in one pass."""
    rules = row_rules(**limits)
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    rows = rows.where(functools.reduce(operator.or_, rules.values()))  # few: names are looked for in these alone
    return rows.select("path", "line", "pmid", F.explode(found).alias("rule")).select("rule", "path", "line", "pmid")


def cross_label(rows: DataFrame) -> DataFrame:
    """Articles that occur with both labels."""
    return rows.groupBy("pmid").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("pmid")


def conflicting(rows: DataFrame) -> DataFrame:
    """Windows that occur with different payloads; a payload travels as a hash."""
    payload = F.xxhash64(*PAYLOAD)
    return rows.select("pmid", "chunk_index", payload.alias("h")).groupBy("pmid", "chunk_index").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b").select("pmid", "chunk_index")


def noncontiguous(rows: DataFrame) -> DataFrame:
    """Articles whose window numbers are not 0, 1, 2, ... once duplicates are merged."""
    own = rows.select("pmid", "chunk_index").distinct().groupBy("pmid").agg(F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), F.count("*").alias("n_chunks"))
    return own.where("first_index <> 0 or last_index <> n_chunks - 1")


def merged(rows: DataFrame) -> DataFrame:
    """One row for each (pmid, chunk_index) with the sorted set of its paths as sources."""
    return rows.groupBy("pmid", "chunk_index").agg(*(F.first(c).alias(c) for c in PAYLOAD), F.array_sort(F.collect_set("path")).alias("sources"))


def articles(rows: DataFrame) -> DataFrame:
    """(pmid, label, n_chunks, sources) of all articles; counts and paths are gathered from distinct pairs."""
    counts = rows.select("pmid", "label", "chunk_index").distinct().groupBy("pmid").agg(F.first("label").alias("label"), F.count("*").alias("n_chunks"))
    paths = rows.select("pmid", "path").distinct().groupBy("pmid").agg(F.array_sort(F.collect_set("path")).alias("sources"))
    return counts.join(paths, "pmid")


def articles_of(windows: DataFrame) -> DataFrame:
    """articles() of windows that are validated(): each occurs once, so one aggregation by article gives counts and paths. An article has few different sources."""
    paths = F.array_sort(F.array_distinct(F.flatten(F.collect_set("sources"))))
    return windows.groupBy("pmid").agg(F.first("label").alias("label"), F.count("*").alias("n_chunks"), paths.alias("sources"))


def load_stats(rows: DataFrame) -> DataFrame:
    """Of each path: lines, windows that are new or merged (in the order of paths and lines), label overrides."""
    first = Window.partitionBy("pmid", "chunk_index").orderBy("path", "line")
    ranked = rows.withColumn("_new", F.row_number().over(first) == 1)
    override = ~F.col("original_label").eqNullSafe(F.col("label"))
    return ranked.groupBy("path", "label").agg(
        F.count("*").alias("lines"), F.count_if("_new").alias("new_chunks"), F.count_if(~F.col("_new")).alias("duplicate_chunks_merged"), F.count_if(override).alias("label_overrides"),
    )


def original_label_counts(rows: DataFrame) -> DataFrame:
    """How often each label stands in each path's rows, None for a missing one."""
    return rows.groupBy("path", F.coalesce(F.col("original_label").cast("string"), F.lit("None")).alias("original_label")).agg(F.count("*").alias("n"))


def validated(rows: DataFrame, **limits) -> DataFrame:
    """merged(rows), or ValueError with the first violations in order of path and line. rows should be a table: where no window repeats, what returns is a view of it,
    and nothing is written again."""
    rows = with_defaults(rows)
    found = [f"{r.path}:{r.line}: {r.rule}" for r in row_violations(rows, **limits).orderBy("path", "line", "rule").limit(20).collect()]
    # windows meet by their keys once: repeats, labels and gaps are all seen in this table
    keys = materialized(rows.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")), "keys")
    repeated = keys.where("n > 1").select(*KEY)
    some = not repeated.isEmpty()
    own = keys.groupBy("pmid").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("chunk_index").alias("first_index"), F.max("chunk_index").alias("last_index"), F.count("*").alias("n_chunks"))
    own = materialized(own.where("low < high or first_index <> 0 or last_index <> n_chunks - 1"), "suspects")
    both, gaps = own.where("low < high"), own.where("first_index <> 0 or last_index <> n_chunks - 1")
    for name, bad in (("both labels", both), *((("conflicting payloads", conflicting(rows)),) if some else ()), ("non-contiguous chunk indices", gaps)):
        found += [f"{name}: {r.pmid}" for r in bad.select("pmid").orderBy("pmid").limit(20).collect()]
    if found:
        raise ValueError("; ".join(found[:20]))
    once = rows.join(repeated, [*KEY], "left_anti") if some else rows
    once = once.select(*KEY, *PAYLOAD, F.array("path").alias("sources"))  # windows that occur once stay where they are
    return materialized(once.unionByName(merged(rows.join(repeated, [*KEY], "left_semi"))), "windows") if some else once

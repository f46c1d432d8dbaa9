"""Identifier cohorts: sampling, splitting, exclusion, overlaps, leakage."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import numbered, sample_rank

NUMERIC_ID = r"^[1-9][0-9]*\z"


def sample(ids: DataFrame, n: int, seed: int = 42, key: str = "pmid") -> DataFrame:
    """The n ids with the least hashes: a top-n, no full sort."""
    if n < 1:
        raise ValueError("the number of articles must be positive")
    return ids.select(key).distinct().orderBy(sample_rank(seed, F.col(key).cast("string")), F.col(key).cast("string")).limit(n)


def eligible(ids: DataFrame, excluded: DataFrame, key: str = "pmid") -> DataFrame:
    return ids.select(key).distinct().join(excluded.select(key).distinct(), key, "left_anti")


def sample_checked(ids: DataFrame, excluded: DataFrame, n: int, seed: int = 42, key: str = "pmid") -> DataFrame:
    """sample() of what the exclusions leave; ValueError if that is less than n."""
    left = eligible(ids, excluded, key)
    if (have := left.count()) < n:
        raise ValueError(f"only {have} eligible articles remain after exclusions; cannot sample {n}")
    return sample(left, n, seed, key)


def sample_counts(ids: DataFrame, excluded: DataFrame, chunks: DataFrame, sampled: DataFrame, key: str = "pmid") -> DataFrame:
    """The counts of a sampling manifest as one row: all four lists meet in one aggregation by id."""
    marks = ("listed", "out", "chunks", "chosen")
    both = None
    for name, df in zip(marks, (ids, excluded, chunks, sampled)):
        own = df.groupBy(key).agg(*(F.count("*").alias(m) if m == name else F.lit(0).cast("long").alias(m) for m in marks))
        both = own if both is None else both.unionByName(own)
    per = both.groupBy(key).agg(*(F.sum(m).alias(m) for m in marks))
    listed, out, chosen = (F.col(m) > 0 for m in ("listed", "out", "chosen"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return per.agg(
        F.count_if(listed).alias("input_articles"), total("chunks", "input_chunks"), F.count_if(listed & out).alias("excluded_input_articles"), F.count_if(listed & ~out).alias("eligible_articles"),
        F.count_if(chosen).alias("sampled_articles"), total(F.when(chosen, F.col("chunks")), "sampled_chunks"),
    )


def split_sizes(n: int, train: float, validation: float, test: float) -> tuple[int, int, int]:
    """Sizes of a two-stage split: the hold-out is rounded up, and the test part of it again."""
    if min(train, validation, test) <= 0 or abs(train + validation + test - 1) > 1e-9:
        raise ValueError("split ratios must be positive and sum to 1")
    hold = math.ceil(n * (validation + test))
    tests = math.ceil(hold * (test / (validation + test)))
    return n - hold, hold - tests, tests


def class_shares(counts: dict[int, int], total: int) -> dict[int, int]:
    """total items in proportion to counts, by largest remainders (of equal ones the larger class, then the label)."""
    n = sum(counts.values())
    exact = {k: c * total / n for k, c in counts.items()}
    out = {k: math.floor(x) for k, x in exact.items()}
    order = sorted(counts, key=lambda k: (-(exact[k] - out[k]), -counts[k], k))
    for k in order[: total - sum(out.values())]:
        out[k] += 1
    return out


def stratified_split(articles: DataFrame, train: float = 0.8, validation: float = 0.1, test: float = 0.1, seed: int = 42, key: str = "pmid", label: str = "label") -> DataFrame:
    """articles with a column split. Sizes follow split_sizes for all and class_shares within labels; members are the
    first of each label in hash order. The driver handles two counts."""
    counts = {r[0]: r[1] for r in articles.groupBy(label).count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError("a stratified split requires both labels")
    n_train, n_validation, n_test = split_sizes(sum(counts.values()), train, validation, test)
    hold = class_shares(counts, n_validation + n_test)
    tests = class_shares(hold, n_test)
    if min(*tests.values(), *(hold[k] - tests[k] for k in counts), *(counts[k] - hold[k] for k in counts)) < 1:
        raise ValueError("each class needs enough articles for all three subsets")
    ranked = numbered(articles, sample_rank(seed, F.col(key).cast("string")), "_rank", [label])
    cut = lambda sizes: F.create_map(*(F.lit(x) for kv in sizes.items() for x in kv))[F.col(label)]
    part = F.when(F.col("_rank") < cut({k: counts[k] - hold[k] for k in counts}), "train").when(F.col("_rank") < cut({k: counts[k] - tests[k] for k in counts}), "validation").otherwise("test")
    return ranked.withColumn("split", part).drop("_rank")


def split_summary(split: DataFrame, label: str = "label") -> DataFrame:
    return split.groupBy("split").agg(F.count("*").alias("articles"), F.count_if(F.col(label) == 1).alias("positive"), F.count_if(F.col(label) == 0).alias("negative"))


def without(rows: DataFrame, excluded: DataFrame, key: str = "pmid") -> DataFrame:
    """Rows whose id is not excluded."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def selected(rows: DataFrame, ids: DataFrame, key: str = "pmid") -> DataFrame:
    """Rows of the given ids."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def removed_ids(rows: DataFrame, excluded: DataFrame, key: str = "pmid") -> DataFrame:
    """Ids of rows that without() drops."""
    return selected(rows.select(key), excluded, key).distinct()


def leakage(external: DataFrame, training: DataFrame, key: str = "pmid") -> DataFrame:
    return external.select(key).intersect(training.select(key))


def numeric_ids(ids: DataFrame, key: str = "pmid") -> DataFrame:
    """Distinct identifiers that are positive numbers without leading zeros, in numeric order."""
    text = F.trim(F.col(key).cast("string"))
    return ids.select(text.alias(key)).where(F.col(key).rlike(NUMERIC_ID)).distinct().orderBy(F.length(key), key)


def overlap_matrix(members: DataFrame, cohorts: DataFrame, key: str = "pmid") -> DataFrame:
    """(cohort_a, cohort_b, shared) for all unordered pairs of cohorts(cohort, ord), a before b, zeros included.

    An id's cohorts meet as one array, so pairs grow with the number of cohorts of an id, not with the sets. The
    pairs of names come from the list of cohorts alone.
    """
    named = members.join(F.broadcast(cohorts), "cohort").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("ord", "cohort"))).alias("own"))
    pairs = F.flatten(F.transform("own", lambda a: F.transform(F.filter("own", lambda b: b["ord"] > a["ord"]), lambda b: F.struct(a["cohort"].alias("cohort_a"), b["cohort"].alias("cohort_b")))))
    counted = named.where(F.size("own") > 1).select(F.inline(pairs)).groupBy("cohort_a", "cohort_b").agg(F.count("*").alias("shared"))
    first, second = (cohorts.select(F.col("cohort").alias(f"cohort_{x}"), F.col("ord").alias(f"_{x}")) for x in "ab")
    every = first.join(second, F.col("_a") < F.col("_b")).select("cohort_a", "cohort_b")
    return every.join(counted, ["cohort_a", "cohort_b"], "left").select("cohort_a", "cohort_b", F.coalesce("shared", F.lit(0)).alias("shared"))


def table_differences(recorded: DataFrame, computed: DataFrame) -> DataFrame:
    """Rows that only one of two tables has."""
    columns = recorded.columns
    a = recorded.exceptAll(computed.select(*columns)).withColumn("only_in", F.lit("recorded"))
    return a.unionByName(computed.select(*columns).exceptAll(recorded).withColumn("only_in", F.lit("computed")))


LINES = 50_000  # lines of a list that are looked at together


def list_violations(ids: DataFrame, by: str = "cohort", key: str = "pmid", line: str = "line") -> DataFrame:
    """(cohort, rule, line) of id lists that are not numeric, or not strictly ascending as numbers. A list is cut into parts of
    LINES line numbers; the last id of each part meets the first of the next."""
    rows = ids.select(by, line, F.col(key).alias("_id"), F.expr(f"{line} div {LINES}").alias("_part"))
    ends = rows.groupBy(by, "_part").agg(F.max_by("_id", line).alias("_last"))
    ends = ends.select(by, "_part", F.lag("_last").over(Window.partitionBy(by).orderBy("_part")).alias("_end"))  # a row for each part
    before = F.lag("_id").over(Window.partitionBy(by, "_part").orderBy(line))
    rows = rows.withColumn("_before", before).join(ends, [by, "_part"]).withColumn("_before", F.coalesce("_before", "_end"))
    number = F.col("_id").rlike(NUMERIC_ID)
    ascending = F.struct(F.length("_before"), F.col("_before")) < F.struct(F.length("_id"), F.col("_id"))
    bad = rows.withColumn("rule", F.when(~number, "not numeric").when(F.col("_before").isNotNull() & ~ascending, "not ascending"))
    return bad.where("rule is not null").select(by, "rule", line)


def relationship_checks(members: DataFrame, pairs: dict[str, tuple[list[str], list[str]]], key: str = "pmid") -> DataFrame:
    """(name, shared): ids that a union of cohorts has in common with another union; with an empty second list, the
    distinct ids of the first."""
    own = members.groupBy(key).agg(F.collect_set("cohort").alias("own"))
    has = lambda names: F.arrays_overlap("own", F.array(*(F.lit(n) for n in names)))
    counts = [F.count_if(has(a) & (has(b) if b else F.lit(True))).alias(name) for name, (a, b) in pairs.items()]
    one = own.agg(*counts)
    return one.select(F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("shared")) for n in pairs))))


def set_equality(members: DataFrame, pairs: dict[str, tuple[list[str], list[str]]], key: str = "pmid") -> DataFrame:
    """(name, equal, only_first, only_second): whether two unions of cohorts hold the same ids, and how many only one has."""
    own = members.groupBy(key).agg(F.collect_set("cohort").alias("own"))
    has = lambda names: F.arrays_overlap("own", F.array(*(F.lit(n) for n in names)))
    one = own.agg(*(F.count_if(x & ~y).alias(f"{k}{i}") for i, (a, b) in enumerate(pairs.values()) for k, x, y in (("a", has(a), has(b)), ("b", has(b), has(a)))))
    rows = (F.struct(F.lit(n).alias("name"), (F.col(f"a{i}") + F.col(f"b{i}") == 0).alias("equal"), F.col(f"a{i}").alias("only_first"), F.col(f"b{i}").alias("only_second")) for i, n in enumerate(pairs))
    return one.select(F.inline(F.array(*rows)))

"""Comparison of groups of scored articles: summaries, intervals, effect sizes, bootstraps, paired outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import quantiles
from ..functions.stats import cohens_d, normal_interval, ratio, wilson
from ..sources.scratch import materialized
from .resampling import LEAF, resampled

LEVELS = (0.025, 0.05, 0.25, 0.5, 0.75, 0.95, 0.975)
REPLICATES = 10_000  # of a bootstrap, unless said otherwise


def group_summary(scored: DataFrame, by: str, score: str = "mean_positive_probability", confidence: float = 0.95) -> DataFrame:
    """A row for each group: counts, moments, intervals of the mean, positives with a Wilson interval."""
    n, positive = F.col("n_articles"), F.col("predicted_positive_count")
    out = scored.groupBy(by).agg(
        F.count("*").alias("n_articles"), F.count_if(F.col("label") == 0).alias("n_label_0"), F.count_if(F.col("label") == 1).alias("n_label_1"), F.first("threshold").alias("threshold"),
        F.avg(score).alias("mean"), F.var_samp(score).alias("sample_variance"), F.stddev_samp(score).alias("standard_deviation"), F.min(score).alias("minimum"), F.max(score).alias("maximum"),
        F.sum("prediction").cast("long").alias("predicted_positive_count"), F.var_samp("prediction").alias("bernoulli_sample_variance"),
    )
    out = out.withColumn("standard_error", F.col("standard_deviation") / F.sqrt(n.cast("double")))
    low, high = normal_interval(F.col("mean"), F.col("standard_error"), confidence)
    w_low, w_high = wilson(positive, n, confidence)
    return out.withColumns({
        "predicted_negative_count": n - positive, "predicted_positive_rate": ratio(positive, n), "predicted_positive_rate_percent": 100.0 * ratio(positive, n),
        "mean_low": low, "mean_high": high, "rate_low": w_low, "rate_high": w_high,
    })


def group_quantiles(scored: DataFrame, by: str, score: str = "mean_positive_probability", levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """(group, level, value), linear between order statistics."""
    counted = materialized(scored.groupBy(by, F.col(score).alias("s")).agg(F.count("*").alias("n")), "scores")
    out = quantiles(counted, [by], "s", "n", levels)
    return out.select(by, F.inline(F.arrays_zip(F.array(*(F.lit(x) for x in levels)).alias("level"), F.col("q").alias("value"))))


def threshold_conflicts(scored: DataFrame) -> DataFrame:
    """One row if the articles were decided by more than one threshold."""
    return scored.agg(F.countDistinct("threshold").alias("thresholds")).where("thresholds > 1")


GROUPS = 10_000  # that pairs are made of, at most


def _pairs(own: DataFrame, by: str, columns: str | list[str], groups: list[str] | None, on: list[str] | None = None) -> DataFrame:
    """Rows of own beside each other for all pairs of groups, first before second by name, or by the order given."""
    place = F.col(by) if groups is None else F.array_position(F.array(*(F.lit(x) for x in groups)), F.col(by))
    a, b = (own.select(F.col(by).alias(f"{x}_group"), place.alias(f"{x}_place"), *(on or []), *(F.col(c).alias(f"{x}_{c}") for c in columns)) for x in ("first", "second"))
    if on:
        return a.join(b, on).where("first_place < second_place")
    return a.join(F.broadcast(b), F.col("first_place") < F.col("second_place"))


def pairwise(scored: DataFrame, by: str, score: str = "mean_positive_probability", groups: list[str] | None = None) -> DataFrame:
    """For all pairs of groups, in name order or the order of `groups`: differences of mean score and positive rate, and
    Cohen's d. Articles are aggregated first: only a row a group meets another, GROUPS of them at most."""
    own = materialized(scored.groupBy(by).agg(F.avg(score).alias("m"), F.var_samp(score).alias("v"), F.count("*").alias("n"), F.avg("prediction").alias("r")), "groups")
    if own.count() > GROUPS:
        raise ValueError(f"pairs of more than {GROUPS} groups")
    both = _pairs(own, by, "mvnr", groups)
    c = F.col
    return both.select("first_group", "second_group", (c("first_m") - c("second_m")).alias("mean_difference"), (c("first_r") - c("second_r")).alias("rate_difference"), cohens_d(c("first_m"), c("first_v"), c("first_n"), c("second_m"), c("second_v"), c("second_n")).alias("cohens_d"))


def _interval(x: str, confidence: float) -> Column:
    a = (1 - confidence) / 2
    return F.percentile(x, F.array(F.lit(a), F.lit(1 - a)))


def bootstrap(values: DataFrame, by: str, value: str, replicates: int = REPLICATES, confidence: float = 0.95, seed: int = 42, order: str = "pmid", leaf: int = LEAF, drawn: DataFrame | None = None) -> DataFrame:
    """Percentile intervals of each group's mean and sample variance. drawn: the replicates, where they are there already."""
    drawn = resampled(values, by, value, replicates, seed, order, leaf) if drawn is None else drawn
    out = drawn.groupBy(by).agg(_interval("mean", confidence).alias("m"), _interval("variance", confidence).alias("v"))
    return out.select(by, F.col("m")[0].alias("mean_low"), F.col("m")[1].alias("mean_high"), F.col("v")[0].alias("variance_low"), F.col("v")[1].alias("variance_high"))


def bootstrap_differences(values: DataFrame, by: str, value: str, replicates: int = REPLICATES, confidence: float = 0.95, seed: int = 42, order: str = "pmid", groups: list[str] | None = None, drawn: DataFrame | None = None) -> DataFrame:
    """Percentile intervals of the difference of means of all pairs of groups, resampled independently. drawn: as in bootstrap()."""
    drawn = resampled(values, by, value, replicates, seed, order) if drawn is None else drawn
    both = _pairs(drawn, by, ["mean"], groups, ["replicate"])
    out = both.withColumn("d", F.col("first_mean") - F.col("second_mean")).groupBy("first_group", "second_group").agg(_interval("d", confidence).alias("q"))
    return out.select("first_group", "second_group", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def paired_bootstrap(pairs: DataFrame, pair: str, a: str, b: str, replicates: int = REPLICATES, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Interval of the mean of a - b over pairs: whole pairs are drawn."""
    one = pairs.select(F.lit("pairs").alias("g"), F.col(pair).alias("pmid"), (F.col(a).cast("double") - F.col(b).cast("double")).alias("d"))
    return bootstrap(one, "g", "d", replicates, confidence, seed).select("mean_low", "mean_high")


def style_rates(rows: DataFrame, by: str, style: str, prediction: str = "prediction") -> DataFrame:
    """Positive rate of each style, and the ratio of A to B (null without B's positives)."""
    out = rows.groupBy(by).agg(*(f(F.when(F.col(style) == s, F.col(prediction))).alias(f"{n}_{s.lower()}") for s in "AB" for f, n in ((F.count, "n"), (F.avg, "rate"))))
    return out.withColumn("ratio", ratio(F.col("rate_a"), F.col("rate_b")))


def paired_outcomes(rows: DataFrame, by: str, pair: str, style: str, prediction: str = "prediction") -> DataFrame:
    """How many complete pairs (one A, one B) are positive in A only, B only, both or neither."""
    own = rows.groupBy(by, pair).agg(F.count("*").alias("n"), *(F.max(F.when(F.col(style) == s, F.col(prediction))).alias(s) for s in "AB")).where("n = 2 and A is not null and B is not null")
    count = lambda a, b, name: F.count_if((F.col("A") == a) & (F.col("B") == b)).alias(name)
    return own.groupBy(by).agg(count(1, 0, "a_only"), count(0, 1, "b_only"), count(1, 1, "both"), count(0, 0, "neither"), F.count("*").alias("total_pairs"))


def pair_violations(rows: DataFrame, pair: str, style: str) -> DataFrame:
    """Pairs that do not have exactly one A and one B."""
    own = rows.groupBy(pair).agg(F.count("*").alias("n_rows"), F.count_if(F.col(style) == "A").alias("n_a"), F.count_if(F.col(style) == "B").alias("n_b"))
    return own.where("n_rows <> 2 or n_a <> 1 or n_b <> 1")


def balance(rows: DataFrame, group: str, category: str) -> DataFrame:
    """Count and share of each category within each group."""
    counts = rows.groupBy(group, category).agg(F.count("*").alias("n"))
    totals = counts.groupBy(group).agg(F.sum("n").alias("total"))
    return counts.join(totals, group).select(group, category, "n", ratio(F.col("n"), F.col("total")).alias("share"))


def combined(scored: DataFrame, by: str) -> DataFrame:
    """Each group's negatives together with the positives of all groups: accuracy, sensitivity, specificity."""
    groups = scored.where("label = 0").groupBy(by).agg(F.count("*").alias("negatives"), F.count_if(F.col("prediction") == 0).alias("tn"))
    shared = scored.where("label = 1").agg(F.count("*").alias("positives"), F.count_if(F.col("prediction") == 1).alias("tp")).withColumn("_one", F.lit(1))
    both = groups.withColumn("_one", F.lit(1)).join(F.broadcast(shared), "_one").drop("_one")
    return both.select(by, "negatives", "positives", ratio(F.col("tn") + F.col("tp"), F.col("negatives") + F.col("positives")).alias("accuracy"), ratio(F.col("tp"), F.col("positives")).alias("sensitivity"), ratio(F.col("tn"), F.col("negatives")).alias("specificity"))

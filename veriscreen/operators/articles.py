"""Window scores to article scores, thresholds and classification metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import prefix_sums, quantiles
from ..functions.stats import ratio
from ..sources.scratch import materialized

OBJECTIVES = ("youden", "f1", "balanced_accuracy")


def article_scores(chunks: DataFrame, key: str = "pmid", probability: str = "positive_probability", keep: tuple[str, ...] = ("label",)) -> DataFrame:
    """One row an article: n_chunks and the unweighted mean of its windows' probabilities; `keep` has one value each."""
    return chunks.groupBy(key).agg(*(F.first(c).alias(c) for c in keep), F.count("*").alias("n_chunks"), F.avg(probability).alias("mean_positive_probability"))


def with_sources(chunks: DataFrame, key: str = "pmid", sources: str = "sources") -> DataFrame:
    """(key, sources): sorted union of the windows' source arrays."""
    return chunks.select(key, F.explode(sources).alias("source")).distinct().groupBy(key).agg(F.array_sort(F.collect_set("source")).alias("sources"))


def prediction_violations(chunks: DataFrame, key: str = "pmid") -> DataFrame:
    """(rule, pmid) of window predictions that cannot be averaged: a probability that is null or outside [0, 1], several
    labels of an article, or window numbers that are not 0, 1, 2, ..."""
    p = F.col("positive_probability")
    bad = chunks.where(p.isNull() | F.isnan(p) | (p < 0) | (p > 1)).select(F.lit("probability").alias("rule"), F.col(key).alias("pmid"))
    grouped = chunks.groupBy(key).agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min("chunk_index").alias("lo"), F.max("chunk_index").alias("hi"), F.count("*").alias("n"), F.countDistinct("chunk_index").alias("d"))
    labels = grouped.where("a <> b").select(F.lit("labels"), key)
    gaps = grouped.where("lo <> 0 or hi <> n - 1 or d <> n").select(F.lit("chunk_index"), key)
    return bad.union(labels).union(gaps)


def metric_violations(articles: DataFrame, key: str = "pmid", label: str = "label", score: str = "mean_positive_probability", threshold: str = "threshold") -> DataFrame:
    """(rule, pmid) of rows that metrics cannot take: labels other than 0 and 1, scores and thresholds that are null or
    outside [0, 1]."""
    outside = lambda c: F.col(c).isNull() | F.isnan(c) | (F.col(c) < 0) | (F.col(c) > 1)
    rules = {"label": ~F.coalesce(F.col(label).isin(0, 1), F.lit(False)), "score": outside(score), "threshold": outside(threshold)}
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return articles.select(F.explode(found).alias("rule"), F.col(key).alias("pmid"))


def checked(articles: DataFrame, **columns) -> DataFrame:
    """articles, or ValueError if there are none or metric_violations() finds any."""
    if articles.isEmpty():
        raise ValueError("no articles to evaluate")
    if bad := metric_violations(articles, **columns).limit(5).collect():
        raise ValueError("; ".join(f"{r.rule}: {r.pmid}" for r in bad))
    return articles


def decide(articles: DataFrame, threshold: float | Column, score: str = "mean_positive_probability") -> DataFrame:
    """prediction (score >= threshold) and the threshold itself."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return articles.withColumn("prediction", (F.col(score) >= t).cast("int")).withColumn("threshold", t.cast("double"))


def score_table(articles: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "mean_positive_probability", prediction: str | None = None) -> DataFrame:
    """A table with a row for each different score s of a group: articles, positives p and negatives n, with `prediction` also
    true positives and negatives. Thresholds, areas and metrics are all made from it: articles are read once."""
    y = F.col(label)
    cells = [] if prediction is None else [F.count_if((y == k) & (F.col(prediction) == k)).alias(name) for k, name in ((1, "hit"), (0, "rejected"))]
    counted = articles.groupBy(*(by or []), F.col(score).alias("s")).agg(F.count("*").alias("all"), F.count_if(y == 1).alias("p"), F.count_if(y == 0).alias("n"), *cells)
    return materialized(counted, "scores")


def _ranked(table: DataFrame, by: list[str]) -> DataFrame:
    """The table with positives and negatives at each score and above."""
    return prefix_sums(table, by, "s", {"tp": "p", "fp": "n"})


def _totals(table: DataFrame, by: list[str]) -> DataFrame:
    out = table.groupBy(*by) if by else table.groupBy()
    return out.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))


def _beside(df: DataFrame, totals: DataFrame, by: list[str]) -> DataFrame:
    """df with the columns of totals, which has a row for each group (one without groups)."""
    if by:
        return df.join(totals, by)
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(totals.withColumn("_one", F.lit(1))), "_one").drop("_one")


def choose_threshold(articles: DataFrame, objective: str = "youden", by: list[str] | None = None, label: str = "label", score: str = "mean_positive_probability") -> DataFrame:
    """The best cut-off of each group among 0, 1 and all scores: by objective, then specificity, sensitivity and the
    higher cut-off. Groups with one class only have none."""
    if objective not in OBJECTIVES:
        raise ValueError(f"objective must be one of {OBJECTIVES}")
    by = by or []
    table = score_table(articles, by, label, score)
    totals = _totals(table, by).where("all_p > 0 and all_n > 0")
    cuts = _ranked(table, by).select(*by, "s", "tp", "fp")
    ends = totals.select(*by, F.lit(0.0).alias("s"), F.col("all_p").alias("tp"), F.col("all_n").alias("fp"))
    none = totals.select(*by, F.lit(1.0).alias("s"), F.lit(0).alias("tp"), F.lit(0).alias("fp"))
    # a cut-off that is also a score has its true counts there; at 0 everything is positive, at 1 what scores 1
    cuts = cuts.union(ends).union(none).groupBy(*by, "s").agg(F.max("tp").alias("tp"), F.max("fp").alias("fp"))
    cuts = _beside(cuts, totals, by)
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "all_p", "all_n"))
    cuts = cuts.withColumns({"sens": tp / p, "spec": (n - fp) / n, "f1": F.coalesce(ratio(2 * tp, tp + fp + p), F.lit(0.0))})
    cuts = cuts.withColumns({"youden": F.col("sens") + F.col("spec") - 1.0, "balanced_accuracy": (F.col("sens") + F.col("spec")) / 2.0})
    best = F.max(F.struct(F.col(objective).alias("o"), "spec", "sens", "s", "f1", "balanced_accuracy", "youden"))
    out = (cuts.groupBy(*by) if by else cuts.groupBy()).agg(best.alias("b"), F.count("*").alias("n_candidates")).where("b is not null")
    return out.select(*by, F.col("b.s").alias("threshold"), F.lit(objective).alias("objective"), F.col("b.o").alias("objective_value"), "n_candidates", F.col("b.sens").alias("sensitivity_recall"), F.col("b.spec").alias("specificity"), F.col("b.f1").alias("f1"), F.col("b.balanced_accuracy").alias("balanced_accuracy"), F.col("b.youden").alias("youden"))


def _areas() -> dict[str, Column]:
    """AUROC and average precision over the rows of a ranked table."""
    above = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2.0))  # positives above each negative
    gain = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    both = (F.sum("p") > 0) & (F.sum("n") > 0)
    return {"auroc": ratio(above, F.sum("p") * F.sum("n")), "average_precision": F.when(both, ratio(gain, F.sum("p")))}


def auroc(articles: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "mean_positive_probability") -> DataFrame:
    """Area under the ROC curve, ties counted half; null for a single class."""
    by = by or []
    rows = _ranked(score_table(articles, by, label, score), by)
    return (rows.groupBy(*by) if by else rows.groupBy()).agg(_areas()["auroc"].alias("auroc"))


def average_precision(articles: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "mean_positive_probability") -> DataFrame:
    """Sum over scores of gained recall times precision there; no row for a group of a single class."""
    by = by or []
    rows = _ranked(score_table(articles, by, label, score), by)
    out = (rows.groupBy(*by) if by else rows.groupBy()).agg(_areas()["average_precision"].alias("average_precision"))
    return out.where("average_precision is not null") if by else out


def metrics(articles: DataFrame, by: list[str] | None = None, label: str = "label", score: str = "mean_positive_probability", prediction: str = "prediction") -> DataFrame:
    """All classification metrics of each group. With one class only, what needs both is null, and so are accuracy, PPV,
    NPV, F1, MCC and Brier score; sensitivity or specificity remain. Articles are read once."""
    by = by or []
    rows, s = _ranked(score_table(articles, by, label, score, prediction), by), F.col("s")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    grouped = (rows.groupBy(*by) if by else rows.groupBy()).agg(
        total("all").alias("n_articles"), total("p").alias("n_positive"), total("n").alias("n_negative"), total("hit").alias("tp"), total("rejected").alias("tn"),
        (total("n") - total("rejected")).alias("fp"), (total("p") - total("hit")).alias("fn"), ratio(F.sum(F.col("p") * (1 - s) * (1 - s) + F.col("n") * s * s), F.sum("all")).alias("brier"),
        *(c.alias(name) for name, c in _areas().items()),
    )
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    both = (F.col("n_positive") > 0) & (F.col("n_negative") > 0)
    sens, spec = ratio(tp, tp + fn), ratio(tn, tn + fp)
    product = (tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn)
    out = grouped.withColumns({
        "sensitivity_recall": sens, "specificity": spec, "false_negative_rate": 1.0 - sens, "false_positive_rate": 1.0 - spec,
        "accuracy": F.when(both, ratio(tp + tn, F.col("n_articles"))), "balanced_accuracy": F.when(both, (sens + spec) / 2.0),
        "precision_ppv": F.when(both, ratio(tp, tp + fp)), "npv": F.when(both, ratio(tn, tn + fn)), "f1": F.when(both, ratio(2 * tp, 2 * tp + fp + fn)),
        "mcc": F.when(both, ratio(tp * tn - fp * fn, F.sqrt(product))), "brier_score": F.when(both, F.col("brier")), "single_class_evaluation": ~both,
    })
    return out.drop("brier")


def score_summary(articles: DataFrame, by: list[str] | None = None, score: str = "mean_positive_probability") -> DataFrame:
    """Least, quartiles (linear), mean and largest score."""
    by = by or []
    counted = materialized(articles.groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n")), "scores")
    rows = quantiles(counted, by, "s", "n", (0.0, 0.25, 0.5, 0.75, 1.0))
    means = (counted.groupBy(*by) if by else counted.groupBy()).agg(ratio(F.sum(F.col("s") * F.col("n")), F.sum("n")).alias("mean"))
    q = lambda k, name: F.col("q")[k].alias(name)
    return _beside(rows, means, by).select(*by, q(0, "min"), q(1, "q1"), q(2, "median"), "mean", q(3, "q3"), q(4, "max"))

"""Scores of token windows. No language model is bundled: the surrogate says nothing about any text."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def surrogate(article: Column, chunk_index: Column) -> Column:
    """A number in [0, 1] from a hash of article and window: the same in any engine."""
    h = F.md5(F.concat_ws(":", article.cast("string"), chunk_index.cast("string")).cast("binary"))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967295.0)


def score_batches(chunks: DataFrame, scorer: Callable[[], Callable], columns: tuple[str, ...] = ("input_ids", "attention_mask", "token_type_ids")) -> DataFrame:
    """The slot for a model: scorer() is called once a task and gives a function from a pandas frame of `columns` to
    probabilities; the windows stay in Arrow batches."""
    schema = chunks.select([c for c in chunks.columns if c not in columns]).schema.add("positive_probability", "double")
    keep = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator) -> Iterator:
        score = scorer()
        for batch in batches:
            yield batch[keep].assign(positive_probability=score(batch[list(columns)]))

    return chunks.mapInPandas(run, schema)


def onnx_scorer(path: str) -> Callable[[], Callable]:
    """A scorer for score_batches from a two-class ONNX model whose file all machines have at path; windows are padded to
    the longest of their batch."""

    def make() -> Callable:
        import numpy as np
        import onnxruntime

        session = onnxruntime.InferenceSession(path, providers=["CPUExecutionProvider"])
        names = [x.name for x in session.get_inputs()]

        def score(batch):
            size = max(map(len, batch["input_ids"]), default=0)
            padded = {c: np.array([[*x, *[0] * (size - len(x))] for x in batch[c]], np.int64).reshape(len(batch), size) for c in names}
            logits = session.run(None, padded)[0]
            return 1 / (1 + np.exp(logits[:, 0] - logits[:, 1]))

        return score

    return make


def mean_loss(chunks: DataFrame, probability: str = "positive_probability", label: str = "label") -> DataFrame:
    """Mean cross-entropy over windows."""
    p = F.when(F.col(label) == 1, F.col(probability)).otherwise(1 - F.col(probability))
    return chunks.agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss"))


def learned_scorer(documents: DataFrame, labels: DataFrame, label: str = "quality", features: int = 1 << 14) -> DataFrame:
    """(doc_id, label, positive_probability) by Spark ML: hashed word counts and a logistic regression, fitted on the
    labelled rows whose hash is not in the held-out fifth."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    from ..functions.text import tokens

    rows = documents.join(labels.select("doc_id", F.col(label).cast("double").alias("label")), "doc_id").select("doc_id", "label", tokens(F.coalesce("text", F.lit(""))).alias("words"))
    fit_on = rows.where(F.abs(F.xxhash64("doc_id")) % 5 > 0)
    model = Pipeline(stages=[HashingTF(inputCol="words", outputCol="features", numFeatures=features), LogisticRegression(maxIter=10, regParam=0.01)]).fit(fit_on)
    out = model.transform(rows)
    return out.select("doc_id", F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("positive_probability"))


def learning_rate(step: int, total: int, warmup_ratio: float, kind: str = "linear", cycles: int = 1) -> float:
    """Factor of the learning rate at a step: a linear warm-up over int(total * warmup_ratio) steps, then a linear or cosine
    decay to 0, or cosines with hard restarts."""
    warm = int(total * warmup_ratio)
    if step < warm:
        return step / max(1, warm)
    done = (step - warm) / max(1, total - warm)
    if done >= 1:
        return 0.0
    if kind == "linear":
        return 1 - done
    if kind == "cosine":
        return 0.5 * (1 + math.cos(math.pi * done))
    if kind == "cosine_with_restarts":
        return 0.5 * (1 + math.cos(math.pi * ((cycles * done) % 1)))
    raise ValueError(f"unknown schedule {kind!r}")


def learning_rates(step: Column, total: int, warmup_ratio: float, kind: str = "linear", cycles: int = 1) -> Column:
    """learning_rate of a column of steps."""
    warm = int(total * warmup_ratio)
    done = (step - warm) / float(max(1, total - warm))
    falls = {"linear": 1 - done, "cosine": 0.5 * (1 + F.cos(math.pi * done)), "cosine_with_restarts": 0.5 * (1 + F.cos(math.pi * (cycles * done - F.floor(cycles * done))))}
    if kind not in falls:
        raise ValueError(f"unknown schedule {kind!r}")
    return F.when(step < warm, step / float(max(1, warm))).when(done >= 1, 0.0).otherwise(falls[kind])


def best_epochs(histories: DataFrame, by: str, tolerance: float = 1e-9) -> DataFrame:
    """(by, epoch): best_epoch of each history(by, epoch, loss, area). A history has as many rows as a run has epochs."""
    none = "cast(null as struct<epoch:int,loss:double,area:double>)"
    tie = f"abs(x.loss - kept.loss) <= greatest({tolerance!r}D * greatest(abs(x.loss), abs(kept.loss)), {tolerance!r}D)"
    fold = f"aggregate(h, {none}, (kept, x) -> if(kept is null or if({tie}, x.area > kept.area, x.loss < kept.loss), x, kept))"
    rows = histories.select(by, F.struct(F.col("epoch").cast("int").alias("epoch"), F.col("loss").cast("double").alias("loss"), F.col("area").cast("double").alias("area")).alias("x"))
    return rows.groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("h")).select(by, F.expr(fold)["epoch"].alias("epoch"))


def best_epoch(history: list[tuple[int, float, float]], tolerance: float = 1e-9) -> int | None:
    """The epoch that checkpoint selection keeps, of (epoch, validation loss, AUROC) in order: a lower loss wins; within
    the relative tolerance the higher AUROC does, and its loss becomes the one to beat."""
    kept: tuple[int, float, float] | None = None
    for epoch, loss, area in history:
        tie = kept is not None and math.isclose(loss, kept[1], rel_tol=tolerance, abs_tol=tolerance)
        if kept is None or (area > kept[2] if tie else loss < kept[1]):
            kept = epoch, loss, area
    return kept and kept[0]

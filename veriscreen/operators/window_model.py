"""A trainable scorer of token windows: hashed counts of token ids and a logistic regression, trained by operators/training.py.

It stands where a transformer would: trained epoch by epoch on the training part's windows, chosen by the validation part's loss (AUROC of
articles between equal ones), saved with the run it belongs to, and applied to windows where they lie. Its size is fixed by
`features`, so a task holds it whatever the data.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import materialized
from . import articles as A
from . import scoring, training

FEATURES = 1 << 15


@dataclass
class WindowModel:
    """state: weights, bias and the optimiser's moments; config: run_id, max_length, vocab_size, type_vocab_size, features, epoch."""

    state: training.AdamW
    config: dict

    def score(self, chunks: DataFrame) -> DataFrame:
        """chunks with positive_probability."""
        weights = self.state.weights

        def run(ids: pa.Array) -> pa.Array:
            return pa.array(1 / (1 + np.exp(-training.logits(weights, ids))))

        return chunks.select("*", F.arrow_udf(run, "double")(F.col("input_ids")).alias("positive_probability"))

    def save(self, path: str) -> None:
        """Weights with their moments as a table, from which training can go on."""
        spark, s = SparkSession.getActiveSession(), self.state
        table = pa.table({"feature": np.arange(len(s.weights)), "weight": s.weights, "first": s.first, "second": s.second})
        spark.createDataFrame(table).coalesce(1).write.parquet(f"{path}/weights")
        spark.createDataFrame([(json.dumps(self.config | {"optimizer_step": s.step}),)], "value string").coalesce(1).write.text(f"{path}/config")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> WindowModel:
        config = json.loads(spark.read.text(f"{path}/config").first().value)
        rows = spark.read.parquet(f"{path}/weights").orderBy("feature").toPandas()  # as many rows as the model has features
        return cls(training.AdamW(*(rows[c].to_numpy(copy=True) for c in ("weight", "first", "second")), config.pop("optimizer_step")), config)


def fit(train: DataFrame, validation: DataFrame, config: dict, settings: training.Settings | None = None, *, features: int = FEATURES, on_best: Callable[[WindowModel], None] | None = None, start: WindowModel | None = None) -> tuple[WindowModel, list[dict]]:
    """The model of the best epoch, and the history: epoch, training loss, validation loss and AUROC. Each epoch goes on from the state that the one
    before has left; on_best gets the model whenever it is better than before. start: a model whose weights training begins with."""
    settings = settings or training.Settings()
    spark = train.sparkSession
    windows = materialized(training.windows_in_order(train), "training-windows")
    n = windows.count()
    state = start.state.copy() if start else training.AdamW(np.zeros(features + 1))
    history, best = [], None
    for epoch in range(1, settings.epochs + 1):
        loss = training.train_epoch(spark, windows, n, state, settings, epoch)
        model = WindowModel(state.copy(), config | {"features": len(state.weights) - 1, "best_epoch": epoch})
        scored = materialized(model.score(validation).select("pmid", "chunk_index", "label", "positive_probability"), "validation-scores")
        history.append({"epoch": epoch, "optimizer_steps": state.step, "train_loss": loss, "validation_chunk_loss": scoring.mean_loss(scored).first().loss, "validation_auroc": A.auroc(A.article_scores(scored)).first().auroc})
        if scoring.best_epoch([(h["epoch"], h["validation_chunk_loss"], h["validation_auroc"]) for h in history]) == epoch:
            best = model
            if on_best:
                on_best(model)
    return best, history

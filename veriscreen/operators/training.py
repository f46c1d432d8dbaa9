"""An epoch of AdamW over token windows, spread over the cluster.

Windows are numbered once. An epoch deals them in a seeded order to batches of equal size: each row computes its place by a keyed
permutation (functions/shuffle.py), and one shuffle writes the windows in this order. Steps follow each other, as stochastic gradients do; what a job does
depends on how large they are. A large step is one job: tasks compute the gradient of their windows at the step's weights, which are broadcast and of fixed
size, sums are merged feature by feature (within a task, then within the shuffle), and the driver gets at most a number a feature. Small steps are taken in
runs of about RUN windows: tasks fold each window's tokens into counts of features before the shuffle, then a job takes a run, whose windows stream in
order through one task that carries the state from step to step; state goes on to the next run. So an epoch has a job for RUN windows, however small its
steps are, and no task sees more than a run.

The model is logistic: a token counts for the feature of its id modulo `features`, weighted by one over the root of the window's length. Loss and
gradient are means over a batch; `accumulation` batches make a step, whose gradient is the mean over as many batches as the step has, so the last one of an
epoch, which may have fewer, weighs as much. Gradients are clipped to a norm, decay goes to weights and not to the bias, and the rate follows
scoring.learning_rate over all steps of all epochs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import numbered
from ..functions.shuffle import shuffled
from ..sources.scratch import drop, materialized, scratch
from . import scoring

SLICE = 50_000  # windows of a step that a task takes, about
RUN = 1 << 16  # windows of a run of small steps, about
LOSS, ROWS = -1, -2  # beside the features


@dataclass(frozen=True)
class Settings:
    epochs: int = 3
    batch_size: int = 1024
    accumulation: int = 1
    learning_rate: float = 0.05
    weight_decay: float = 0.025
    warmup_ratio: float = 0.15
    scheduler: str = "cosine"
    max_grad_norm: float = 1.0
    seed: int = 42

    def __post_init__(self):
        for name in ("epochs", "batch_size", "accumulation"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name.replace('_', ' ')} must be positive")
        if self.learning_rate <= 0 or self.max_grad_norm <= 0:
            raise ValueError("learning rate and gradient norm must be positive")
        if self.weight_decay < 0:
            raise ValueError("weight decay cannot be negative")
        if not 0 <= self.warmup_ratio < 1:
            raise ValueError("the warm-up is a share of all steps below 1")
        scoring.learning_rate(0, 1, 0.0, self.scheduler)

    def batches(self, n: int) -> int:
        return -(-n // self.batch_size)

    def steps(self, n: int) -> int:
        """Optimiser steps of an epoch over n windows."""
        return -(-self.batches(n) // self.accumulation)


@dataclass
class AdamW:
    """Weights of the features, then the bias, with their moments: all that training has to remember between steps."""

    weights: np.ndarray
    first: np.ndarray = field(default=None)
    second: np.ndarray = field(default=None)
    step: int = 0

    def __post_init__(self):
        self.first = np.zeros_like(self.weights) if self.first is None else self.first
        self.second = np.zeros_like(self.weights) if self.second is None else self.second

    def update(self, gradient: np.ndarray, rate: float, settings: Settings, betas: tuple[float, float] = (0.9, 0.999), epsilon: float = 1e-8) -> None:
        gradient = gradient * min(1.0, settings.max_grad_norm / (float(np.linalg.norm(gradient)) + 1e-6))
        self.step += 1
        self.weights[:-1] *= 1 - rate * settings.weight_decay
        self.first = betas[0] * self.first + (1 - betas[0]) * gradient
        self.second = betas[1] * self.second + (1 - betas[1]) * gradient * gradient
        mean, spread = self.first / (1 - betas[0] ** self.step), self.second / (1 - betas[1] ** self.step)
        self.weights = self.weights - rate * mean / (np.sqrt(spread) + epsilon)

    def copy(self) -> AdamW:
        return AdamW(self.weights.copy(), self.first.copy(), self.second.copy(), self.step)


def flat(ids: pa.Array, features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the tokens of all windows: window, feature, and weight in its window."""
    size = np.diff(ids.offsets.to_numpy())
    window = np.repeat(np.arange(len(size)), size)
    return window, ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64) % features, 1 / np.sqrt(np.maximum(size, 1))[window]


def logits(weights: np.ndarray, ids: pa.Array) -> np.ndarray:
    window, feature, share = flat(ids, len(weights) - 1)
    return np.bincount(window, weights[feature] * share, len(ids)) + weights[-1]


def windows_in_order(chunks: DataFrame) -> DataFrame:
    """(row, label, input_ids): windows numbered from 0 by a hash of article and window."""
    key = F.md5(F.concat_ws(":", F.col("pmid").cast("string"), F.col("chunk_index").cast("string")).cast("binary"))
    own = materialized(chunks.select("pmid", "chunk_index", F.col("label").cast("int").alias("label"), "input_ids"), "windows")  # numbering reads them a few times
    return numbered(own, key, "row")


def dealt(rows: DataFrame, n: int, settings: Settings, epoch: int) -> DataFrame:
    """rows(row, ...) with their place in an epoch, batch, step, and share of the step's gradient."""
    batch, acc = settings.batch_size, settings.accumulation
    out = rows.withColumn("place", shuffled(F.col("row"), n, settings.seed, epoch))
    out = out.withColumn("batch", F.floor(F.col("place") / batch)).withColumn("step", F.floor(F.col("batch") / acc))
    in_batch = F.least(F.lit(batch), F.lit(n) - F.col("batch") * batch)
    in_step = F.least(F.lit(acc), F.lit(settings.batches(n)) - F.col("step") * acc)
    return out.withColumn("share", 1.0 / (in_batch * in_step))


def gradients(rows: DataFrame, weights) -> DataFrame:
    """(feature, g): the summed gradient of rows(label, input_ids, share) at broadcast weights; summed loss and number of rows as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        total, loss, count = np.zeros(len(w)), 0.0, 0
        for batch in batches:
            ids, y, share = batch.column(1), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            window, feature, part = flat(ids, len(w) - 1)
            z = np.bincount(window, w[feature] * part, len(y)) + w[-1]
            d = (1 / (1 + np.exp(-z)) - y) * share
            total[:-1] += np.bincount(feature, d[window] * part, len(w) - 1)
            total[-1] += d.sum()
            loss += float(np.logaddexp(0, np.where(y == 1, -z, z)).sum())
            count += len(y)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, [LOSS, ROWS])), pa.array(np.append(total[some], [loss, count]))], ["feature", "g"])

    return rows.select("label", "input_ids", "share").mapInArrow(run, "feature long, g double").groupBy("feature").agg(F.sum("g").alias("g"))


def _counted(rows: DataFrame, features: int) -> DataFrame:
    """rows with the different features of each window's tokens and their weights in the window instead of input_ids."""
    from pyspark.sql import types as T

    kept = [f for f in rows.schema if f.name != "input_ids"]
    schema = T.StructType([*kept, T.StructField("features", T.ArrayType(T.IntegerType())), T.StructField("parts", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("input_ids")
            window, feature, _ = flat(ids, features)
            own, count = np.unique(window * features + feature, return_counts=True)
            size = np.maximum(np.diff(ids.offsets.to_numpy()), 1)
            offsets = pa.array(np.searchsorted(own, np.arange(len(ids) + 1) * features).astype(np.int32))
            parts = count / np.sqrt(size)[own // features]
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in ((own % features).astype(np.int32), parts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *lists], schema.names)

    return rows.mapInArrow(run, schema)


def _run_of_steps(rows: DataFrame, state, settings: Settings, before: int, total: int) -> DataFrame:
    """One row: weights, moments, summed loss and number of rows after the steps of rows(step, label, share, features, parts), which lie in order in one
    partition. before: steps of the epochs before, total: of all epochs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, loss, count = state.value.copy(), None, 0.0, 0
        gradient = np.zeros(len(own.weights))

        def taken() -> None:
            own.update(gradient, settings.learning_rate * scoring.learning_rate(before + at, total, settings.warmup_ratio, settings.scheduler), settings)

        for batch in batches:
            step, y, share = (batch.column(k).to_numpy() for k in range(3))
            offsets = batch.column(3).offsets.to_numpy()
            feature, part = (batch.column(k).flatten().to_numpy() for k in (3, 4))
            offsets = offsets - offsets[0]
            window = np.repeat(np.arange(len(step)), np.diff(offsets))
            edges = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), len(step)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if at is not None and step[a] != at:
                    taken()
                    gradient[:] = 0
                at = int(step[a])
                some = slice(offsets[a], offsets[b])
                f, x, at_window = feature[some], part[some], window[some] - a
                z = np.bincount(at_window, own.weights[f] * x, b - a) + own.weights[-1]
                d = (1 / (1 + np.exp(-z)) - y[a:b]) * share[a:b]
                gradient[:-1] += np.bincount(f, d[at_window] * x, len(gradient) - 1)
                gradient[-1] += d.sum()
                loss += float(np.logaddexp(0, np.where(y[a:b] == 1, -z, z)).sum())
                count += b - a
        if at is not None:
            taken()
            yield pa.RecordBatch.from_arrays([*(pa.array([x.tolist()], pa.list_(pa.float64())) for x in (own.weights, own.first, own.second)), pa.array([loss]), pa.array([count])], ["weights", "first", "second", "loss", "count"])

    return rows.select("step", "label", "share", "features", "parts").mapInArrow(run, "weights array<double>, first array<double>, second array<double>, loss double, count long")


def _by_runs(spark: SparkSession, windows: DataFrame, n: int, state: AdamW, settings: Settings, epoch: int, per_run: int) -> float:
    """train_epoch where per_run steps make a run."""
    path, steps = scratch(spark, "epoch"), settings.steps(n)
    rows = _counted(dealt(windows, n, settings, epoch).select("place", "step", "label", "share", "input_ids"), len(state.weights) - 1)
    runs = -(-steps // per_run)
    rows = rows.withColumn("run", F.floor(F.col("step") / per_run))
    rows.repartition(min(runs, 1000), "run").sortWithinPartitions("run", "place").write.partitionBy("run").parquet(path)
    table = spark.read.schema("place long, step long, label int, share double, features array<int>, parts array<double>, run long").parquet(path)
    total, count = 0.0, 0
    for run in range(runs):
        held = spark.sparkContext.broadcast(state)
        own = table.where(F.col("run") == run).coalesce(1).sortWithinPartitions("place")
        r = _run_of_steps(own, held, settings, (epoch - 1) * steps, settings.epochs * steps).first()  # three numbers a feature
        held.destroy()
        state.weights, state.first, state.second = (np.array(x) for x in (r.weights, r.first, r.second))
        state.step += min(per_run, steps - run * per_run)
        total, count = total + r.loss, count + r["count"]
    drop(spark, path)
    return total / count


def train_epoch(spark: SparkSession, windows: DataFrame, n: int, state: AdamW, settings: Settings, epoch: int) -> float:
    """One epoch (from 1) over n windows(row, label, input_ids), which should be a table. state goes on; returns the mean loss over the epoch's windows, each
    at the weights of its step."""
    if not n:
        raise ValueError("there are no windows to train on")
    if (per_run := RUN // (settings.batch_size * settings.accumulation)) > 1:
        return _by_runs(spark, windows, n, state, settings, epoch, per_run)
    path, steps = scratch(spark, "epoch"), settings.steps(n)
    per_step = settings.batch_size * settings.accumulation
    rows = dealt(windows, n, settings, epoch).withColumn("slice", F.col("place") % max(1, per_step // SLICE))
    rows.repartition("step", "slice").select("step", "label", "input_ids", "share").write.partitionBy("step").parquet(path)
    table = spark.read.schema("label int, input_ids array<int>, share double, step long").parquet(path)
    total, count = 0.0, 0
    for step in range(steps):
        weights = spark.sparkContext.broadcast(state.weights)
        gradient = np.zeros(len(state.weights))
        for r in gradients(table.where(F.col("step") == step), weights).collect():  # a number a feature
            if r.feature == LOSS:
                total += r.g
            elif r.feature == ROWS:
                count += int(r.g)
            else:
                gradient[r.feature] = r.g
        weights.destroy()
        rate = settings.learning_rate * scoring.learning_rate((epoch - 1) * steps + step, settings.epochs * steps, settings.warmup_ratio, settings.scheduler)
        state.update(gradient, rate, settings)
    drop(spark, path)
    return total / count

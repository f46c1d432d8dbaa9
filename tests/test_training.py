"""Training of the window model against plain NumPy, and the seeded order of its windows."""

import hashlib
import math
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from veriscreen.functions import shuffle
from veriscreen.operators import scoring, training, window_model


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 9_973, 250_000])
def test_order_is_a_permutation(n):
    orders = [shuffle.places(np.arange(n), n, shuffle.keys(1, epoch)) for epoch in (1, 2)]
    for own in orders:
        assert (np.sort(own) == np.arange(n)).all()
    if n > 16:
        assert (orders[0] != orders[1]).mean() > 0.5
        assert abs(np.corrcoef(orders[0], np.arange(n))[0, 1]) < 4 / math.sqrt(n)


def test_order_does_not_depend_on_how_rows_are_cut(spark):
    n = 1000
    want = shuffle.places(np.arange(n), n, shuffle.keys(7, 3)).tolist()
    for parts in (1, 7):
        rows = spark.range(n).repartition(parts).withColumn("place", shuffle.shuffled(F.col("id"), n, 7, 3)).orderBy("id").collect()
        assert [r.place for r in rows] == want


def made(n, seed=1):
    rng = random.Random(seed)
    return [(f"p{k // 2}", k % 2, (k // 2) % 2, [rng.randrange(7) + 3 * ((k // 2) % 2) for _ in range(rng.randint(1, 12))]) for k in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "pmid string, chunk_index int, label int, input_ids array<int>").repartition(3)


def plain(rows, settings, features):
    """Losses and weights of all epochs, one window after the other."""
    rows = sorted(rows, key=lambda r: hashlib.md5(f"{r[0]}:{r[1]}".encode()).hexdigest())
    n = len(rows)
    x = np.zeros((n, features + 1))
    for k, r in enumerate(rows):
        for i in r[3]:
            x[k, i % features] += 1 / math.sqrt(len(r[3]))
        x[k, -1] = 1
    y = np.array([r[2] for r in rows], float)
    w, m, v, t, losses = np.zeros(features + 1), 0.0, 0.0, 0, []
    batches = [range(a, min(a + settings.batch_size, n)) for a in range(0, n, settings.batch_size)]
    groups = [batches[a : a + settings.accumulation] for a in range(0, len(batches), settings.accumulation)]
    for epoch in range(1, settings.epochs + 1):
        order = np.argsort(shuffle.places(np.arange(n), n, shuffle.keys(settings.seed, epoch)))
        total = 0.0
        for group in groups:
            g = np.zeros_like(w)
            for batch in group:
                own = order[list(batch)]
                p = 1 / (1 + np.exp(-(x[own] @ w)))
                total -= float((y[own] * np.log(p) + (1 - y[own]) * np.log(1 - p)).sum())
                g += x[own].T @ (p - y[own]) / len(own) / len(group)
            norm = np.sqrt((g * g).sum())
            g *= min(1, settings.max_grad_norm / (norm + 1e-6))
            rate = settings.learning_rate * scoring.learning_rate(t, len(groups) * settings.epochs, settings.warmup_ratio, settings.scheduler)
            t += 1
            w[:-1] -= rate * settings.weight_decay * w[:-1]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        losses.append(total / n)
    return losses, w


@pytest.mark.parametrize("settings", [
    training.Settings(epochs=3, batch_size=8, accumulation=3, learning_rate=0.1), training.Settings(epochs=2, batch_size=100, scheduler="linear", warmup_ratio=0.0),
    training.Settings(epochs=2, batch_size=7, accumulation=2, max_grad_norm=0.01, scheduler="cosine_with_restarts", seed=5),
])
def test_epochs_equal_a_plain_version(spark, settings):
    rows = made(61)
    windows = training.windows_in_order(frame(spark, rows)).cache()
    state, losses = training.AdamW(np.zeros(9)), []
    for epoch in range(1, settings.epochs + 1):
        losses.append(training.train_epoch(spark, windows, len(rows), state, settings, epoch))
    want, weights = plain(rows, settings, 8)
    assert losses == pytest.approx(want, abs=1e-9) and state.weights == pytest.approx(weights, abs=1e-8)
    assert state.step == settings.epochs * settings.steps(len(rows))
    windows.unpersist()


def test_model_goes_on_from_its_state_and_is_kept_when_better(spark, tmp_path):
    rows = frame(spark, made(40))
    kept = []
    settings = training.Settings(epochs=2, batch_size=8)
    model, history = window_model.fit(rows, rows, {"run_id": "r"}, settings, features=16, on_best=kept.append)
    assert [h["optimizer_steps"] for h in history] == [5, 10] and history[1]["train_loss"] < history[0]["train_loss"]
    assert [m.config["best_epoch"] for m in kept] == [1, 2] and kept[-1] is model and kept[0].state.step == 5
    model.save(str(tmp_path / "m"))
    again = window_model.WindowModel.load(spark, str(tmp_path / "m"))
    assert again.config == model.config and again.state.step == 10 and (again.state.weights == model.state.weights).all() and (again.state.second == model.state.second).all()
    more, _ = window_model.fit(rows, rows, {}, training.Settings(epochs=1, batch_size=8), start=again)
    assert more.state.step == 15 and again.state.step == 10
    scores = model.score(rows).orderBy("pmid", "chunk_index").collect()
    ids = [r.input_ids for r in scores]
    want = [1 / (1 + math.exp(-(sum(model.state.weights[i % 16] for i in x) / math.sqrt(len(x)) + model.state.weights[16]))) for x in ids]
    assert [r.positive_probability for r in scores] == pytest.approx(want)


@pytest.mark.parametrize("name, value", [("epochs", 0), ("batch_size", 0), ("accumulation", 0), ("learning_rate", 0.0), ("weight_decay", -1.0), ("warmup_ratio", 1.0), ("max_grad_norm", 0.0), ("scheduler", "none")])
def test_settings_out_of_range_are_refused(name, value):
    with pytest.raises(ValueError):
        training.Settings(**{name: value})


def test_nothing_to_train_on_is_refused(spark):
    with pytest.raises(ValueError, match="no windows"):
        training.train_epoch(spark, frame(spark, []), 0, training.AdamW(np.zeros(3)), training.Settings(), 1)


def test_a_step_reads_only_its_own_windows(spark):
    windows = training.windows_in_order(frame(spark, made(30)))
    dealt = training.dealt(windows, 30, training.Settings(batch_size=4, accumulation=2), 1)
    sizes = {(r.step, r.batch): r["count"] for r in dealt.groupBy("step", "batch").count().collect()}
    assert sizes == {(k // 2, k): 4 if k < 7 else 2 for k in range(8)}
    shares = {r.step: r.s for r in dealt.groupBy("step").agg(F.sum("share").alias("s")).collect()}
    assert shares == pytest.approx({k: 1.0 for k in range(4)})


def test_schedules_and_choice_as_columns(spark):
    for kind in ("linear", "cosine", "cosine_with_restarts"):
        rows = spark.range(0, 130).select("id", scoring.learning_rates(F.col("id"), 100, 0.12, kind, 3).alias("f")).collect()
        assert [r.f for r in rows] == pytest.approx([scoring.learning_rate(r.id, 100, 0.12, kind, 3) for r in rows], abs=1e-12)
    rng = random.Random(3)
    histories = {f"h{k}": [(e, rng.choice([0.5, 0.5 + 1e-12, 0.4, 0.6]), rng.choice([0.7, 0.8])) for e in range(1, 7)] for k in range(30)}
    df = spark.createDataFrame([(k, *x) for k, own in histories.items() for x in own], "run string, epoch int, loss double, area double").repartition(4)
    assert {r.run: r.epoch for r in scoring.best_epochs(df, "run").collect()} == {k: scoring.best_epoch(own) for k, own in histories.items()}


@pytest.mark.parametrize("run", [1, 50, 1 << 16])
def test_small_steps_are_taken_in_runs(spark, monkeypatch, run):
    """Jobs are as many as runs of windows, not as steps; weights do not depend on how steps are cut into runs."""
    monkeypatch.setattr(training, "RUN", run)
    settings, rows = training.Settings(epochs=2, batch_size=3, accumulation=2), made(121, seed=9)
    windows = training.windows_in_order(frame(spark, rows)).cache()
    windows.count()
    state, losses, jobs = training.AdamW(np.zeros(9)), [], []
    for epoch in (1, 2):
        spark.sparkContext.setJobGroup(f"epoch-{run}-{epoch}", "")
        losses.append(training.train_epoch(spark, windows, len(rows), state, settings, epoch))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"epoch-{run}-{epoch}")))
    want, weights = plain(rows, settings, 8)
    assert losses == pytest.approx(want, abs=1e-9) and state.weights == pytest.approx(weights, abs=1e-8) and state.step == 42
    if run == 1 << 16:
        assert max(jobs) < settings.steps(len(rows))
    windows.unpersist()

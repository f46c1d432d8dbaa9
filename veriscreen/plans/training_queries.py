"""Queries of training: the seeded order of windows, and weights after epochs of optimiser steps."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from ..functions import shuffle, text
from .. import cli
from ..operators import training
from ..sources import storage
from ..sources.scratch import materialized
from . import command_queries as C
from . import queries as Q
from .file_queries import _lines
from .queries import query, rounded

SETTINGS = training.Settings(epochs=2, batch_size=48, accumulation=3)
FEATURES = 4

_TEXTS = f"t AS (SELECT pmid, label, list_transform({Q.WORDS}, lambda x: length(x)) AS w FROM l)"
_WINDOWS = f"""{Q.SQL_LABELLED},
{_TEXTS},
k AS (SELECT *, len(w) AS n FROM t),
c AS (SELECT pmid, label, w, unnest(range(0, {Q._K}))::INTEGER AS chunk_index FROM k),
x AS (SELECT pmid, chunk_index, label, w[chunk_index * {Q.STEP} + 1 : chunk_index * {Q.STEP} + {Q.CAP}] AS ids, row_number() OVER (ORDER BY md5(pmid || ':' || chunk_index)) - 1 AS row FROM c),
z AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS b FROM x)"""


def _half(side: str, other: str, key: int, length: str) -> str:
    """SQL of a half round: `side` is shifted by the mixed other side."""
    mixing = "".join(f"(xor(m{j}, m{j} >> 16) * {shuffle.FACTOR}) & {shuffle.MASK} AS m{j + 1}, " for j in range(2))
    return f"xor({other}, {key}) AS m0, {mixing}({side} + xor(m2, m2 >> 16)) % {length} AS new_{side}"


def _round_sql(rows: str, epoch: int) -> str:
    """SQL that sends `place` of rows(row, place, n, a, b) through the rounds of an epoch's order."""
    rows = f"SELECT row, n, a, b, place // b AS l, place % b AS r FROM ({rows})"
    for k, key in enumerate(shuffle.keys(SETTINGS.seed, epoch)):
        side, other, length = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
        rows = f"SELECT row, n, a, b, new_{side} AS {side}, {other} FROM (SELECT *, {_half(side, other, key, length)} FROM ({rows}))"
    return f"SELECT row, l * b + r AS place, n, a, b FROM ({rows})"


def _order_sql(epoch: int) -> str:
    """CTE o<epoch>(row, place)."""
    start = "SELECT row, row AS place, n, a, b FROM x, z"
    return f"o{epoch} AS ({_round_sql(start, epoch)} UNION ALL {_round_sql(f'SELECT * FROM o{epoch} WHERE place >= n', epoch)})"


_ORDERS = ", ".join(_order_sql(e) for e in (1, 2))
_PLACED = " UNION ALL ".join(f"SELECT {e} AS epoch, row, place FROM o{e} WHERE place < n" for e in (1, 2))


def _windows(spark, sf_dir):
    rows = Q.labelled(spark, sf_dir)
    ids = F.transform(text.tokens(F.col("text")), lambda x: F.length(x))
    rows = text.windows(rows.select("pmid", "label", ids.alias("ids")), "ids", Q.MAX_LENGTH, Q.OVERLAP)
    return rows.select("pmid", "chunk_index", "label", F.col("chunk").alias("input_ids"))


@query(f"""WITH RECURSIVE {_WINDOWS}, {_ORDERS}, p AS ({_PLACED})
SELECT epoch::INTEGER AS epoch, place // {SETTINGS.batch_size} AS batch, count(*) AS n_windows, md5(string_agg(pmid || ':' || chunk_index, ',' ORDER BY place)) AS windows_md5 FROM p JOIN x USING (row) GROUP BY ALL""")
def shuffled_batches(spark, sf_dir):
    """Batches of equal size, in another order each epoch."""
    rows = _windows(spark, sf_dir)
    key = F.concat_ws(":", F.col("pmid").cast("string"), F.col("chunk_index").cast("string"))
    own = materialized(training.numbered(rows.select(key.alias("window")), F.md5(F.col("window").cast("binary")), "row"), "windows")
    n, out = own.count(), None
    for epoch in (1, 2):
        part = training.dealt(own, n, SETTINGS, epoch).select(F.lit(epoch).alias("epoch"), "batch", "place", "window")
        out = part if out is None else out.union(part)
    members = F.transform(F.array_sort(F.collect_list(F.struct("place", "window"))), lambda x: x["window"])  # a batch each
    return out.groupBy("epoch", "batch").agg(F.count("*").alias("n_windows"), F.md5(F.array_join(members, ",").cast("binary")).alias("windows_md5"))


_W = "w[1] * x0 + w[2] * x1 + w[3] * x2 + w[4] * x3 + w[5]"
_D = f"(1 / (1 + exp(-({_W}))) - label) * share"
_LOSS = f"ln(1 + exp(CASE WHEN label = 1 THEN -({_W}) ELSE {_W} END))"
_FACTOR = f"CASE WHEN k < warm THEN k / greatest(1, warm)::DOUBLE ELSE 0.5 * (1 + cos(pi() * ((k - warm) / greatest(1, total - warm)::DOUBLE))) END * {SETTINGS.learning_rate}"
_STEP = f"""SELECT k + 1 AS k, total, warm, per_epoch, loss,
list_transform(range(1, 6), lambda i: 0.9 * m[i] + 0.1 * g[i]) AS m, list_transform(range(1, 6), lambda i: 0.999 * v[i] + 0.001 * g[i] * g[i]) AS v,
list_transform(range(1, 6), lambda i: w[i] * CASE WHEN i < 5 THEN 1 - rate * {SETTINGS.weight_decay} ELSE 1 END - rate * ((0.9 * m[i] + 0.1 * g[i]) / (1 - pow(0.9, k + 1))) / (sqrt((0.999 * v[i] + 0.001 * g[i] * g[i]) / (1 - pow(0.999, k + 1))) + 1e-8)) AS w
FROM (SELECT * EXCLUDE (g), {_FACTOR} AS rate, list_transform(g, lambda y: y * least(1, {SETTINGS.max_grad_norm} / (sqrt(list_sum(list_transform(g, lambda u: u * u))) + 1e-6))) AS g
FROM (SELECT s.k, s.total, s.warm, s.per_epoch, any_value(s.w) AS w, any_value(s.m) AS m, any_value(s.v) AS v, any_value(s.loss) + sum({_LOSS}) AS loss, [sum({_D} * x0), sum({_D} * x1), sum({_D} * x2), sum({_D} * x3), sum({_D})] AS g
FROM (SELECT k, total, warm, per_epoch, w, m, v, CASE WHEN k % per_epoch = 0 THEN 0.0 ELSE loss END AS loss FROM s) s JOIN f ON f.epoch = s.k // s.per_epoch + 1 AND f.step = s.k % s.per_epoch GROUP BY s.k, s.total, s.warm, s.per_epoch))"""
_COUNTS = ", ".join(f"len(list_filter(ids, lambda y: y % {FEATURES} = {j})) / sqrt(len(ids)) AS x{j}" for j in range(FEATURES))


_WEIGHTS = f"""{_ORDERS}, p AS ({_PLACED}),
q AS (SELECT epoch, row, place // {SETTINGS.batch_size} AS batch FROM p),
f AS (SELECT epoch, batch // {SETTINGS.accumulation} AS step, label, {_COUNTS},
1.0::DOUBLE / (least({SETTINGS.batch_size}, n - batch * {SETTINGS.batch_size}) * least({SETTINGS.accumulation}, ceil(n / {SETTINGS.batch_size})::BIGINT - (batch // {SETTINGS.accumulation}) * {SETTINGS.accumulation})) AS share FROM q JOIN x USING (row), z),
s AS (SELECT 0 AS k, 2 * ceil(ceil(n / {SETTINGS.batch_size}) / {SETTINGS.accumulation})::BIGINT AS total, floor(2 * ceil(ceil(n / {SETTINGS.batch_size}) / {SETTINGS.accumulation}) * {SETTINGS.warmup_ratio})::BIGINT AS warm, ceil(ceil(n / {SETTINGS.batch_size}) / {SETTINGS.accumulation})::BIGINT AS per_epoch,
0.0::DOUBLE AS loss, [0.0, 0, 0, 0, 0]::DOUBLE[] AS m, [0.0, 0, 0, 0, 0]::DOUBLE[] AS v, [0.0, 0, 0, 0, 0]::DOUBLE[] AS w FROM z
UNION ALL {_STEP})"""


@query(f"""WITH RECURSIVE {_WINDOWS}, {_WEIGHTS}
SELECT (k // per_epoch)::INTEGER AS epoch, k::INTEGER AS optimizer_steps, round(loss / n, 6) AS train_loss, round(w[1], 6) AS w0, round(w[2], 6) AS w1, round(w[3], 6) AS w2, round(w[4], 6) AS w3, round(w[5], 6) AS bias FROM s, z WHERE k > 0 AND k % per_epoch = 0""")
def training_weights(spark, sf_dir):
    """Weights of a model of four features and its training loss after each of two epochs: batches of 48 windows, three a step, the last step of fewer."""
    windows = materialized(training.windows_in_order(_windows(spark, sf_dir)), "training-windows")
    n, state, out = windows.count(), training.AdamW(np.zeros(FEATURES + 1)), []
    for epoch in (1, 2):
        loss = training.train_epoch(spark, windows, n, state, SETTINGS, epoch)
        out.append((epoch, state.step, loss, *state.weights.tolist()))
    return rounded(spark.createDataFrame(out, "epoch int, optimizer_steps int, train_loss double, w0 double, w1 double, w2 double, w3 double, bias double"))


_FITTED = f"""WITH RECURSIVE l AS (SELECT d.doc_id AS pmid, source || ' ' || coalesce(text, '') AS text, quality AS label FROM documents d JOIN labels USING (doc_id)),
{_TEXTS},
k AS (SELECT *, len(w) AS n FROM t),
c AS (SELECT pmid, label, w, unnest(range(0, {Q._K}))::INTEGER AS chunk_index FROM k),
al AS (SELECT pmid, chunk_index, label, w[chunk_index * {Q.STEP} + 1 : chunk_index * {Q.STEP} + {Q.CAP}] AS ids FROM c),
x AS (SELECT al.*, row_number() OVER (ORDER BY md5(pmid || ':' || chunk_index)) - 1 AS row FROM al JOIN sp0 USING (pmid) WHERE split = 'train'),
z AS (SELECT count(*) AS n, ceil(sqrt(count(*)))::BIGINT AS a, ceil(count(*) / ceil(sqrt(count(*))))::BIGINT AS b FROM x),
{_WEIGHTS},
ep AS (SELECT k // per_epoch AS epoch, w FROM s WHERE k > 0 AND k % per_epoch = 0),
pr AS (SELECT epoch, pmid, label, 1 / (1 + exp(-({_W}))) AS p FROM ep, (SELECT *, {_COUNTS} FROM al)),
vl AS (SELECT epoch, avg(-ln(greatest(CASE WHEN label = 1 THEN p ELSE 1 - p END, 1e-12))) AS loss FROM pr JOIN sp0 USING (pmid) WHERE split = 'validation' GROUP BY epoch)
SELECT pmid, any_value(label) AS label, avg(p) AS m FROM pr WHERE epoch = (SELECT epoch FROM vl ORDER BY loss, epoch LIMIT 1) GROUP BY pmid"""


@query(f"WITH {C._SPLIT}, a0 AS ({_FITTED}), {C._THRESHOLD} SELECT {C._METRICS} FROM a0 JOIN sp0 USING (pmid), best WHERE split = 'test' GROUP BY t")
def command_train_fitted(spark, sf_dir):
    """The training command with the model that it fits: two epochs over four features, the better one by its validation loss, a threshold on the validation part, counts of the test part."""
    rows = Q.labelled(spark, sf_dir)
    ids = F.transform(text.tokens(F.concat_ws(" ", "source", F.coalesce("text", F.lit("")))), lambda x: F.length(x))
    rows = materialized(rows.select(F.col("pmid").cast("string").alias("pmid"), "label", ids.alias("ids")), "tokens")  # texts are cut once, for both roles
    rows = text.windows(rows, "ids", Q.MAX_LENGTH, Q.OVERLAP)
    size = F.size("chunk")
    rows = rows.select("pmid", "chunk_index", "label", F.col("chunk").alias("input_ids"), F.array_repeat(F.lit(1), size).alias("attention_mask"), F.array_repeat(F.lit(0), size).alias("token_type_ids"))
    roles = {label: _lines(rows.where(F.col("label") == label), f"fitted-{label}") for label in (0, 1)}
    out = C._folder(spark, "fitted")
    settings = ["--epochs", SETTINGS.epochs, "--train-batch-size", SETTINGS.batch_size, "--gradient-accumulation-steps", SETTINGS.accumulation, "--features", FEATURES]
    cli.main(["train", "--positive", roles[1], "--negative", roles[0], "--max-length", str(Q.MAX_LENGTH), "--output-dir", out, "--train-ratio", "0.8", "--validation-ratio", "0.1", "--test-ratio", "0.1", *map(str, settings)], spark)
    found = json.loads(storage.read(f"{out}/internal_results.json"))
    return C._counts(spark, found["metrics"], found["threshold"])

"""Named queries over the provided tables, each with the SQL that gives the same rows.

An article is a labelled document: labels.quality is its label, lang its linguistic group, source its cohort. Windows hold
126 words and overlap by 16. Floating-point results are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import shuffle, stats, text

from ..operators import articles as A
from ..operators import audit, cohorts, corpus, scoring
from ..sources.scratch import materialized

MAX_LENGTH, OVERLAP = 128, 16
CAP, STEP = MAX_LENGTH - 2, MAX_LENGTH - 2 - OVERLAP
REPLICATES = DRAWN = audit.REPLICATES  # of the queries and of their SQL
TRAIN = (0.8, 0.1, 0.1)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, kind in df.dtypes if kind == "double"})


# ---- shared inputs


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, text, lang, source, label) of all labelled documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id").select(F.col("doc_id").alias("pmid"), "text", "lang", "source", F.col("quality").alias("label"), "toxic")


def tokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(spark, sf_dir).withColumn("w", text.tokens(F.col("text"))).drop("text")


def scored_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored row for each window; tokens do not leave the scan."""
    rows = labelled(spark, sf_dir).withColumn("n_tokens", F.size(text.tokens(F.col("text")))).drop("text")
    rows = rows.withColumn("k", text.window_count(F.col("n_tokens"), CAP, OVERLAP)).where("k > 0")
    rows = rows.withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return rows.withColumn("positive_probability", scoring.surrogate(F.col("pmid"), F.col("chunk_index"))).drop("k", "n_tokens")


def scored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = A.article_scores(scored_chunks(spark, sf_dir), keep=("label", "lang", "source", "toxic"))
    return out.withColumn("mean_positive_probability", F.round("mean_positive_probability", 9))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.decide(scored_articles(spark, sf_dir), 0.5)


def window_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows as rows of window files: article = hash of the text, path = source, so that exact copies in several
    sources repeat; token ids are word lengths."""
    rows = tokenized_by_hash(spark, sf_dir)
    rows = text.windows(rows, "ids", MAX_LENGTH, OVERLAP)
    return rows.select("path", "line", "pmid", "chunk_index", "label", "original_label", F.col("chunk").alias("input_ids"), F.array_repeat(F.lit(1), F.size("chunk")).alias("attention_mask"), F.lit(None).cast("array<int>").alias("token_type_ids"))


def tokenized_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir)
    ids = F.transform(text.tokens(F.col("text")), lambda x: F.length(x))
    return rows.select(F.md5(F.col("text").cast("binary")).alias("pmid"), F.col("source").alias("path"), F.col("pmid").alias("line"), "label", F.col("toxic").alias("original_label"), ids.alias("ids"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pmid, cohort): which texts a source holds."""
    return table(spark, sf_dir, "documents").select(F.md5(F.col("text").cast("binary")).alias("pmid"), F.col("source").alias("cohort")).distinct()


WORDS = r"list_filter(string_split_regex(lower(text), '[ \t\n\r\f]+'), lambda x: x <> '')"
_K = f"CASE WHEN n = 0 THEN 0 WHEN n <= {CAP} THEN 1 ELSE (n - {CAP} + {STEP} - 1) // {STEP} + 1 END"
SQL_LABELLED = "l AS (SELECT d.doc_id AS pmid, text, lang, source, quality AS label, toxic FROM documents d JOIN labels USING (doc_id))"
SQL_CHUNKS = rf"""{SQL_LABELLED},
t AS (SELECT pmid, lang, source, label, toxic, len({WORDS}) AS n FROM l),
c AS (SELECT *, unnest(range(0, {_K}))::INTEGER AS chunk_index FROM t),
s AS (SELECT *, ('0x' || substr(md5(pmid || ':' || chunk_index), 1, 8))::BIGINT::DOUBLE / 4294967295.0 AS p FROM c)"""
SQL_ARTICLES = f"""{SQL_CHUNKS},
a AS (SELECT pmid, any_value(label) AS label, any_value(lang) AS lang, any_value(source) AS source, any_value(toxic) AS toxic, count(*) AS n_chunks, round(avg(p), 9) AS m FROM s GROUP BY pmid)"""
SQL_DECIDED = f"{SQL_ARTICLES},\nq AS (SELECT *, (m >= 0.5)::INTEGER AS prediction, 0.5::DOUBLE AS threshold FROM a)"
SQL_ROWS = rf"""{SQL_LABELLED},
h AS (SELECT md5(text) AS pmid, source AS path, pmid AS line, label, toxic AS original_label, list_transform({WORDS}, lambda x: length(x)) AS w FROM l),
hk AS (SELECT *, len(w) AS n FROM h),
r AS (SELECT path, line, pmid, label, original_label, w, unnest(range(0, {_K}))::INTEGER AS chunk_index FROM hk),
w AS (SELECT path, line, pmid, chunk_index, label, original_label, w[chunk_index * {STEP} + 1 : chunk_index * {STEP} + {CAP}] AS ids FROM r)"""


# ---- corpus layer


@query(f"WITH {SQL_ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY pmid, chunk_index ORDER BY path, line) = 1 AS new FROM w) SELECT path, label, count(*) AS lines, count(*) FILTER (new) AS new_chunks, count(*) FILTER (NOT new) AS duplicate_chunks_merged, count(*) FILTER (original_label IS DISTINCT FROM label) AS label_overrides FROM n GROUP BY path, label")
def corpus_load_stats(spark, sf_dir):
    return corpus.load_stats(window_rows(spark, sf_dir))


@query(f"WITH {SQL_ROWS} SELECT path, coalesce(original_label::VARCHAR, 'None') AS original_label, count(*) AS n FROM w GROUP BY ALL")
def corpus_original_labels(spark, sf_dir):
    return corpus.original_label_counts(window_rows(spark, sf_dir))


@query(f"WITH {SQL_ROWS} SELECT pmid, chunk_index, min(len(ids)) AS n_ids, array_to_string(list_sort(list(DISTINCT path)), ',') AS sources FROM w GROUP BY pmid, chunk_index")
def corpus_dedup_chunks(spark, sf_dir):
    out = corpus.merged(window_rows(spark, sf_dir))
    return out.select("pmid", "chunk_index", F.size("input_ids").cast("long").alias("n_ids"), F.array_join("sources", ",").alias("sources"))


@query(f"WITH {SQL_ROWS} SELECT pmid, min(label) AS label, count(DISTINCT chunk_index) AS n_chunks, array_to_string(list_sort(list(DISTINCT path)), ',') AS sources FROM w GROUP BY pmid HAVING min(label) = max(label)")
def corpus_articles(spark, sf_dir):
    rows = window_rows(spark, sf_dir)
    return corpus.articles(rows.join(corpus.cross_label(rows), "pmid", "left_anti")).select("pmid", "label", "n_chunks", F.array_join("sources", ",").alias("sources"))


@query(f"WITH {SQL_ROWS}, v AS (SELECT path, line, pmid, unnest(list_filter([CASE WHEN len(ids) > 100 THEN 'too_long' END, CASE WHEN list_max(ids) >= 24 THEN 'id_beyond_vocabulary' END], lambda x: x IS NOT NULL)) AS rule FROM w) SELECT rule, path, line, pmid, count(*) AS n FROM v GROUP BY ALL")
def corpus_violations(spark, sf_dir):
    rows = corpus.with_defaults(window_rows(spark, sf_dir))
    return corpus.row_violations(rows, max_length=100, vocabulary=24).groupBy("rule", "path", "line", "pmid").agg(F.count("*").alias("n"))


@query(f"WITH {SQL_ROWS} SELECT pmid FROM w GROUP BY pmid HAVING min(label) < max(label)")
def corpus_cross_label(spark, sf_dir):
    return corpus.cross_label(window_rows(spark, sf_dir))


@query(f"WITH {SQL_ROWS} SELECT pmid, chunk_index FROM w GROUP BY pmid, chunk_index HAVING count(DISTINCT (label, ids)) > 1")
def corpus_conflicts(spark, sf_dir):
    return corpus.conflicting(corpus.with_defaults(window_rows(spark, sf_dir)))


@query(f"WITH {SQL_ROWS}, o AS (SELECT DISTINCT pmid, chunk_index FROM w WHERE chunk_index <> 1) SELECT pmid, min(chunk_index) AS first_index, max(chunk_index) AS last_index, count(*) AS n_chunks FROM o GROUP BY pmid HAVING min(chunk_index) <> 0 OR max(chunk_index) <> count(*) - 1")
def corpus_noncontiguous(spark, sf_dir):
    """Windows with number 1 are taken out first, so that there are gaps to find."""
    return corpus.noncontiguous(window_rows(spark, sf_dir).where("chunk_index <> 1"))


# ---- text and windows


@query(rf"SELECT doc_id, md5(array_to_string({WORDS}, ' ')) AS tokens_md5, len({WORDS}) AS n_tokens FROM (SELECT doc_id, trim(source) || chr(10) || chr(10) || trim(text) AS text FROM documents)")
def text_compose_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.compose(F.col("source"), F.col("text")).alias("t"))
    docs = docs.select("doc_id", text.tokens(F.col("t")).alias("w"))
    return docs.select("doc_id", F.md5(F.array_join("w", " ").cast("binary")).alias("tokens_md5"), F.size("w").cast("long").alias("n_tokens"))


@query(f"WITH {SQL_ROWS} SELECT path, line, chunk_index, len(ids) AS n_ids, list_sum(ids)::BIGINT AS id_sum FROM w")
def chunk_windows(spark, sf_dir):
    total = F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return window_rows(spark, sf_dir).select("path", "line", "chunk_index", F.size("input_ids").cast("long").alias("n_ids"), total.alias("id_sum"))


@query(rf"WITH d AS (SELECT doc_id, len({WORDS}) AS n FROM documents) SELECT doc_id, n AS n_tokens, ({_K})::BIGINT AS n_chunks FROM d")
def chunk_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))
    return docs.withColumn("n_chunks", text.window_count(F.col("n_tokens"), CAP, OVERLAP).cast("long"))


def _wrapped(spark, sf_dir):
    ids, mask, kinds = text.wrap(F.col("input_ids"))
    return window_rows(spark, sf_dir).select("path", "line", "chunk_index", ids.alias("ids"), mask.alias("mask"), kinds.alias("kinds"))


@query(f"WITH {SQL_ROWS} SELECT path, line, chunk_index, md5('{text.CLS},' || array_to_string(ids, ',') || ',{text.SEP}') AS ids_md5, (len(ids) + 2)::BIGINT AS n_mask, 0::BIGINT AS type_sum FROM w")
def chunk_wrap_special(spark, sf_dir):
    ids = F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").cast("binary"))
    return _wrapped(spark, sf_dir).select("path", "line", "chunk_index", ids.alias("ids_md5"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_mask"), F.aggregate("kinds", F.lit(0).cast("long"), lambda a, x: a + x).alias("type_sum"))


@query(f"WITH {SQL_ROWS}, b AS (SELECT *, line // 16 AS batch FROM w), m AS (SELECT batch, max(len(ids)) + 2 AS size FROM b GROUP BY batch) SELECT path, line, chunk_index, batch, size::BIGINT AS n_ids, (size - len(ids) - 2)::BIGINT AS n_pad, (len(ids) + 2)::BIGINT AS n_mask FROM b JOIN m USING (batch)")
def chunk_pad_batch(spark, sf_dir):
    rows = _wrapped(spark, sf_dir).drop("mask", "kinds").withColumn("batch", F.expr("line div 16"))
    out = text.pad_batches(rows, "batch", "ids")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return out.select("path", "line", "chunk_index", "batch", F.size("ids").cast("long").alias("n_ids"), (F.size("ids") - total("attention_mask")).alias("n_pad"), total("attention_mask").alias("n_mask"))


@query(f"WITH {SQL_CHUNKS} SELECT lang, count(*) AS n_chunks, round(avg(-ln(greatest(CASE WHEN label = 1 THEN p ELSE 1 - p END, 1e-12))), 6) AS loss FROM s GROUP BY lang")
def chunk_mean_loss(spark, sf_dir):
    rows = scored_chunks(spark, sf_dir)
    p = F.when(F.col("label") == 1, F.col("positive_probability")).otherwise(1 - F.col("positive_probability"))
    return rounded(rows.groupBy("lang").agg(F.count("*").alias("n_chunks"), F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("loss")))


@query(f"WITH {SQL_ROWS} SELECT path, min(len(ids)) AS shortest, max(len(ids)) AS longest, count(DISTINCT len(ids)) AS lengths FROM w GROUP BY path")
def chunk_length_stats(spark, sf_dir):
    size = F.size("input_ids").cast("long")
    return window_rows(spark, sf_dir).groupBy("path").agg(F.min(size).alias("shortest"), F.max(size).alias("longest"), F.countDistinct(size).alias("lengths"))


# ---- scores, thresholds, metrics


@query(f"WITH {SQL_CHUNKS} SELECT pmid, chunk_index, label, round(p, 6) AS positive_probability FROM s")
def chunk_scores(spark, sf_dir):
    return rounded(scored_chunks(spark, sf_dir).select("pmid", "chunk_index", "label", "positive_probability"))


@query(f"WITH {SQL_ARTICLES} SELECT pmid, label, n_chunks, round(m, 6) AS mean_positive_probability FROM a")
def article_mean_score(spark, sf_dir):
    return rounded(scored_articles(spark, sf_dir).select("pmid", "label", "n_chunks", "mean_positive_probability"))


@query(f"WITH {SQL_DECIDED} SELECT pmid, label, round(m, 6) AS mean_positive_probability, prediction, threshold FROM q")
def article_hard_prediction(spark, sf_dir):
    return rounded(decided(spark, sf_dir).select("pmid", "label", "mean_positive_probability", "prediction", "threshold"))


@query(f"WITH {SQL_CHUNKS}, g AS (SELECT pmid, label, chunk_index, CASE WHEN chunk_index = 3 THEN 1.5 ELSE p END AS p FROM s WHERE chunk_index <> 1) SELECT 'probability' AS rule, pmid FROM g WHERE p < 0 OR p > 1 UNION ALL SELECT 'chunk_index', pmid FROM g GROUP BY pmid HAVING min(chunk_index) <> 0 OR max(chunk_index) <> count(*) - 1")
def prediction_violations(spark, sf_dir):
    """Faults are put in first: window 1 is taken out, window 3 gets a probability of 1.5."""
    bad = scored_chunks(spark, sf_dir).where("chunk_index <> 1").withColumn("positive_probability", F.when(F.col("chunk_index") == 3, 1.5).otherwise(F.col("positive_probability")))
    return A.prediction_violations(bad)


def _threshold_sql(objective: str) -> str:
    return f"""WITH {SQL_ARTICLES},
tt AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM a),
k AS (SELECT m AS s FROM a UNION SELECT 0.0 UNION SELECT 1.0),
v AS (SELECT s, (SELECT count(*) FROM a WHERE label = 1 AND m >= s) AS tp, (SELECT count(*) FROM a WHERE label = 0 AND m >= s) AS fp FROM k),
x AS (SELECT s, tp / p AS sens, (n - fp) / n AS spec, coalesce((2 * tp)::DOUBLE / nullif(tp + fp + p, 0), 0.0) AS f1 FROM v, tt),
y AS (SELECT *, sens + spec - 1.0 AS youden, (sens + spec) / 2.0 AS balanced_accuracy FROM x)
SELECT round(s, 6) AS threshold, '{objective}' AS objective, round({objective}, 6) AS objective_value, (SELECT count(*) FROM k) AS n_candidates, round(sens, 6) AS sensitivity_recall, round(spec, 6) AS specificity, round(f1, 6) AS f1, round(balanced_accuracy, 6) AS balanced_accuracy, round(youden, 6) AS youden
FROM y ORDER BY {objective} DESC, spec DESC, sens DESC, s DESC LIMIT 1"""


def _threshold(objective: str):
    def run(spark, sf_dir):
        return rounded(A.choose_threshold(scored_articles(spark, sf_dir), objective))

    return run


for _name, _objective in (("youden", "youden"), ("f1", "f1"), ("balanced", "balanced_accuracy")):
    QUERIES[f"threshold_{_name}"] = _threshold(_objective)
    ORACLE_SQL[f"threshold_{_name}"] = _threshold_sql(_objective)


def _cells(by: str) -> str:
    return f"SELECT {by}, count(*) AS n_articles, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (label = 0) AS n_negative, count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 0) AS tn, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, avg((m - label) * (m - label)) AS brier FROM q GROUP BY {by}"


def _metrics_sql(by: str, where: str = "true") -> str:
    return f"""WITH {SQL_ARTICLES}, q AS (SELECT *, (m >= 0.5)::INTEGER AS prediction FROM a WHERE {where}),
g AS ({_cells(by)}),
u AS (SELECT x.{by} AS k, sum(CASE WHEN x.m > y.m THEN 1.0 WHEN x.m = y.m THEN 0.5 ELSE 0.0 END) / count(*) AS auroc FROM q x JOIN q y ON x.{by} = y.{by} AND x.label = 1 AND y.label = 0 GROUP BY x.{by}),
z AS (SELECT {by} AS k, m, count(*) FILTER (label = 1) AS p, count(*) AS n FROM q GROUP BY {by}, m),
zz AS (SELECT *, sum(p) OVER (PARTITION BY k ORDER BY m DESC) AS tp, sum(n) OVER (PARTITION BY k ORDER BY m DESC) AS tn, sum(p) OVER (PARTITION BY k) AS tot FROM z),
ap AS (SELECT k, sum(p / tot * tp / tn) AS ap FROM zz WHERE tot > 0 GROUP BY k),
e AS (SELECT *, n_positive > 0 AND n_negative > 0 AS b, tp / nullif(tp + fn, 0) AS sens, tn / nullif(tn + fp, 0) AS spec FROM g)
SELECT {by}, n_articles, n_positive, n_negative, tp, tn, fp, fn, round(sens, 6) AS sensitivity_recall, round(spec, 6) AS specificity, round(1.0 - sens, 6) AS false_negative_rate, round(1.0 - spec, 6) AS false_positive_rate,
  CASE WHEN b THEN round((tp + tn) / n_articles, 6) END AS accuracy, CASE WHEN b THEN round((sens + spec) / 2.0, 6) END AS balanced_accuracy, CASE WHEN b THEN round(tp / nullif(tp + fp, 0), 6) END AS precision_ppv, CASE WHEN b THEN round(tn / nullif(tn + fn, 0), 6) END AS npv,
  CASE WHEN b THEN round((2 * tp) / nullif(2 * tp + fp + fn, 0), 6) END AS f1, CASE WHEN b THEN round((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) END AS mcc, CASE WHEN b THEN round(brier, 6) END AS brier_score, NOT b AS single_class_evaluation,
  CASE WHEN b THEN round(auroc, 6) END AS auroc, CASE WHEN b THEN round(ap, 6) END AS average_precision
FROM e LEFT JOIN u ON u.k = {by} LEFT JOIN ap ON ap.k = {by}"""


@query(f"WITH {SQL_DECIDED}, g AS ({_cells('source')}) SELECT * EXCLUDE (brier) FROM g")
def confusion_by_group(spark, sf_dir):
    return A.metrics(decided(spark, sf_dir), ["source"]).select("source", "n_articles", "n_positive", "n_negative", "tp", "tn", "fp", "fn")


@query(_metrics_sql("lang"))
def article_metrics(spark, sf_dir):
    return rounded(A.metrics(decided(spark, sf_dir), ["lang"]))


@query(_metrics_sql("lang", "label = 1"))
def single_class_metrics(spark, sf_dir):
    return rounded(A.metrics(decided(spark, sf_dir).where("label = 1"), ["lang"]))


@query(f"WITH {SQL_ARTICLES} SELECT round(sum(CASE WHEN x.m > y.m THEN 1.0 WHEN x.m = y.m THEN 0.5 ELSE 0.0 END) / count(*), 6) AS auroc FROM a x JOIN a y ON x.label = 1 AND y.label = 0")
def auroc(spark, sf_dir):
    return rounded(A.auroc(scored_articles(spark, sf_dir)))


@query(f"WITH {SQL_ARTICLES}, z AS (SELECT m, count(*) FILTER (label = 1) AS p, count(*) AS n FROM a GROUP BY m), y AS (SELECT p, sum(p) OVER (ORDER BY m DESC) AS tp, sum(n) OVER (ORDER BY m DESC) AS tn, sum(p) OVER () AS tot FROM z) SELECT round(sum(p / tot * tp / tn), 6) AS average_precision FROM y")
def average_precision(spark, sf_dir):
    return rounded(A.average_precision(scored_articles(spark, sf_dir)))


@query(f"WITH {SQL_DECIDED}, g AS ({_cells('lang')}) SELECT lang, round(brier, 6) AS brier_score, round((tp * tn - fp * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc FROM g WHERE n_positive > 0 AND n_negative > 0")
def brier_mcc(spark, sf_dir):
    return rounded(A.metrics(decided(spark, sf_dir), ["lang"]).where("not single_class_evaluation").select("lang", "brier_score", "mcc"))


@query(f"WITH {SQL_ARTICLES} SELECT lang, round(min(m), 6) AS min, round(quantile_cont(m, 0.25), 6) AS q1, round(quantile_cont(m, 0.5), 6) AS median, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.75), 6) AS q3, round(max(m), 6) AS max FROM a GROUP BY lang")
def score_summary(spark, sf_dir):
    return rounded(A.score_summary(scored_articles(spark, sf_dir), ["lang"]))


# ---- cohorts


def _ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmid"))


def _listed(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("pmid"))


_HASH = "sha256('42' || chr(0) || doc_id)"


@query(f"SELECT doc_id AS pmid FROM documents ORDER BY {_HASH}, doc_id::VARCHAR LIMIT 100")
def sample_hash_topn(spark, sf_dir):
    return cohorts.sample(_ids(spark, sf_dir), 100)


@query(f"SELECT doc_id AS pmid FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY {_HASH}, doc_id::VARCHAR LIMIT 50")
def sample_with_exclusions(spark, sf_dir):
    return cohorts.sample_checked(_ids(spark, sf_dir), _listed(spark, sf_dir), 50)


@query(f"WITH {SQL_CHUNKS}, e AS (SELECT DISTINCT pmid FROM l WHERE toxic = 1), i AS (SELECT DISTINCT pmid FROM s), x AS (SELECT pmid FROM i WHERE pmid NOT IN (SELECT pmid FROM e) ORDER BY sha256('42' || chr(0) || pmid), pmid::VARCHAR LIMIT 40) SELECT (SELECT count(*) FROM i) AS input_articles, (SELECT count(*) FROM s) AS input_chunks, (SELECT count(*) FROM i WHERE pmid IN (SELECT pmid FROM e)) AS excluded_input_articles, (SELECT count(*) FROM i WHERE pmid NOT IN (SELECT pmid FROM e)) AS eligible_articles, (SELECT count(*) FROM x) AS sampled_articles, (SELECT count(*) FROM s WHERE pmid IN (SELECT pmid FROM x)) AS sampled_chunks")
def sample_manifest_counts(spark, sf_dir):
    chunks = materialized(scored_chunks(spark, sf_dir).select("pmid", "chunk_index", "toxic"), "windows")
    excluded = chunks.where("toxic = 1")
    return cohorts.sample_counts(chunks, excluded, chunks, cohorts.sample(cohorts.eligible(chunks, excluded), 40))


def _split(spark, sf_dir):
    return cohorts.stratified_split(labelled(spark, sf_dir).select("pmid", "label"), *TRAIN)


_SPLIT = f"""WITH {SQL_LABELLED}, c AS (SELECT label, count(*) AS c FROM l GROUP BY label), n AS (SELECT sum(c)::BIGINT AS n FROM c),
h AS (SELECT n, ceil(n * 0.2::DOUBLE)::BIGINT AS hold, ceil(ceil(n * 0.2::DOUBLE) * (0.1::DOUBLE / 0.2::DOUBLE))::BIGINT AS test FROM n),
f AS (SELECT label, c, c * hold / n AS ex, floor(c * hold / n)::BIGINT AS fl, hold, test FROM c, h),
fr AS (SELECT *, row_number() OVER (ORDER BY ex - fl DESC, c DESC, label) <= hold - sum(fl) OVER () AS up FROM f),
ho AS (SELECT label, c, fl + up::BIGINT AS hc, hold, test FROM fr),
g AS (SELECT *, hc * test / hold AS ex, floor(hc * test / hold)::BIGINT AS fl FROM ho),
gr AS (SELECT *, row_number() OVER (ORDER BY ex - fl DESC, hc DESC, label) <= test - sum(fl) OVER () AS up FROM g),
cut AS (SELECT label, c - hc AS a, c - (fl + up::BIGINT) AS b FROM gr),
k AS (SELECT pmid, label, row_number() OVER (PARTITION BY label ORDER BY sha256('42' || chr(0) || pmid)) - 1 AS r FROM l),
sp AS (SELECT pmid, label, CASE WHEN r < a THEN 'train' WHEN r < b THEN 'validation' ELSE 'test' END AS split FROM k JOIN cut USING (label))"""


@query(f"{_SPLIT} SELECT pmid, label, split FROM sp")
def split_hash_stratified(spark, sf_dir):
    return _split(spark, sf_dir)


@query(f"{_SPLIT} SELECT split, count(*) AS articles, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative FROM sp GROUP BY split")
def split_summary(spark, sf_dir):
    return cohorts.split_summary(_split(spark, sf_dir))


@query(f"{_SPLIT}, x AS (SELECT sp.split, md5(text) AS h FROM sp JOIN documents d ON d.doc_id = sp.pmid) SELECT count(DISTINCT h) AS shared_texts FROM x WHERE split = 'test' AND h IN (SELECT h FROM x WHERE split = 'train')")
def split_leakage_check(spark, sf_dir):
    """Texts of the test part that the training part has too."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmid"), F.md5(F.col("text").cast("binary")).alias("h"))
    both = _split(spark, sf_dir).join(texts, "pmid")
    return cohorts.leakage(both.where("split = 'test'"), both.where("split = 'train'"), "h").agg(F.count("*").alias("shared_texts"))


@query("SELECT doc_id AS pmid, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_filter_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("pmid"), "lang", "source")
    return cohorts.without(rows, _listed(spark, sf_dir))


@query("SELECT DISTINCT doc_id AS pmid FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def removed_ids(spark, sf_dir):
    return cohorts.removed_ids(_ids(spark, sf_dir), _listed(spark, sf_dir))


@query(f"WITH {SQL_CHUNKS} SELECT pmid, chunk_index FROM s WHERE pmid IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def semi_select_chunks(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("pmid"))
    return cohorts.selected(scored_chunks(spark, sf_dir).select("pmid", "chunk_index"), toxic)


def _cohort_list(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("cohort")).distinct().withColumn("ord", F.col("cohort"))


_MATRIX = "WITH m AS (SELECT DISTINCT md5(text) AS h, source AS c FROM documents), n AS (SELECT DISTINCT c FROM m), p AS (SELECT x.c AS cohort_a, y.c AS cohort_b FROM n x JOIN n y ON x.c < y.c) SELECT cohort_a, cohort_b, (SELECT count(*) FROM m x JOIN m y USING (h) WHERE x.c = cohort_a AND y.c = cohort_b) AS shared FROM p"


@query(_MATRIX)
def cohort_overlap_matrix(spark, sf_dir):
    return cohorts.overlap_matrix(members(spark, sf_dir), _cohort_list(spark, sf_dir))


@query(f"WITH r AS ({_MATRIX}) SELECT cohort_a, cohort_b, s AS shared, o AS only_in FROM (SELECT cohort_a, cohort_b, unnest([shared + 1, shared]) AS s, unnest(['recorded', 'computed']) AS o FROM r WHERE cohort_a = 'src0')")
def cohort_table_differences(spark, sf_dir):
    """A recorded table with wrong numbers for one cohort, against the recomputed one."""
    computed = cohort_overlap_matrix(spark, sf_dir)
    recorded = computed.withColumn("shared", F.col("shared") + F.when(F.col("cohort_a") == "src0", 1).otherwise(0))
    return cohorts.table_differences(recorded, computed)


_UNIONS = {"internal": (["src0", "src1", "src2"], []), "internal_external": (["src0", "src1", "src2"], ["src3"]), "audit_overlap": (["src4"], ["src5"])}


@query("WITH m AS (SELECT DISTINCT md5(text) AS h, source AS c FROM documents), g AS (SELECT h, list(c) AS o FROM m GROUP BY h) SELECT * FROM (VALUES ('internal', (SELECT count(*) FROM g WHERE list_has_any(o, ['src0', 'src1', 'src2']))), ('internal_external', (SELECT count(*) FROM g WHERE list_has_any(o, ['src0', 'src1', 'src2']) AND list_contains(o, 'src3'))), ('audit_overlap', (SELECT count(*) FROM g WHERE list_contains(o, 'src4') AND list_contains(o, 'src5')))) t(name, shared)")
def cohort_relationship_checks(spark, sf_dir):
    return cohorts.relationship_checks(members(spark, sf_dir), _UNIONS)


@query("WITH i AS (SELECT DISTINCT conv_id::VARCHAR AS pmid FROM conversations) SELECT pmid, length(pmid)::BIGINT AS digits, row_number() OVER (PARTITION BY length(pmid) ORDER BY pmid) AS place FROM i WHERE regexp_full_match(pmid, '[1-9][0-9]*')")
def id_export_numeric_sort(spark, sf_dir):
    ids = cohorts.numeric_ids(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("pmid")))
    ids = ids.withColumn("digits", F.length("pmid").cast("long"))
    return ids.withColumn("place", F.row_number().over(Window.partitionBy("digits").orderBy("pmid")).cast("long"))


@query("WITH d AS (SELECT source AS cohort, doc_id AS line, md5(text) AS h, doc_id::VARCHAR AS t FROM documents), r AS (SELECT cohort, line, CASE WHEN line % 7 = 3 THEN 'x' || t WHEN line % 11 = 5 THEN '1' ELSE t END AS pmid FROM d), b AS (SELECT *, lag(pmid) OVER (PARTITION BY cohort ORDER BY line) AS before FROM r) SELECT cohort, CASE WHEN NOT regexp_full_match(pmid, '[1-9][0-9]*') THEN 'not numeric' ELSE 'not ascending' END AS rule, line FROM b WHERE NOT regexp_full_match(pmid, '[1-9][0-9]*') OR (before IS NOT NULL AND NOT (length(before) < length(pmid) OR (length(before) = length(pmid) AND before < pmid)))")
def cohort_list_violations(spark, sf_dir):
    """Faults are put in first: every seventh id is no number, some are 1."""
    line, own = F.col("line"), F.col("line").cast("string")
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("cohort"), F.col("doc_id").alias("line"))
    return cohorts.list_violations(rows.withColumn("pmid", F.when(line % 7 == 3, F.concat(F.lit("x"), own)).when(line % 11 == 5, "1").otherwise(own)))


# ---- audit


_SUMMARY = f"WITH {SQL_DECIDED}, g AS (SELECT lang, count(*) AS n, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, any_value(threshold) AS t, avg(m) AS m, var_samp(m) AS v, stddev_samp(m) AS sd, min(m) AS lo, max(m) AS hi, sum(prediction)::BIGINT AS k, var_samp(prediction) AS bv FROM q GROUP BY lang), e AS (SELECT *, sd / sqrt(n) AS se, k / n AS r FROM g)"
_Z = repr(stats.z_value(0.95))
_WL = f"round(greatest(0.0, (r + {_Z} * {_Z} / (2 * n) - {_Z} * sqrt(r * (1 - r) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 6)"
_WH = f"round(least(1.0, (r + {_Z} * {_Z} / (2 * n) + {_Z} * sqrt(r * (1 - r) / n + {_Z} * {_Z} / (4 * n * n))) / (1 + {_Z} * {_Z} / n)), 6)"


@query(f"{_SUMMARY} SELECT lang, n AS n_articles, n0 AS n_label_0, n1 AS n_label_1, t AS threshold, round(m, 6) AS mean, round(v, 6) AS sample_variance, round(sd, 6) AS standard_deviation, round(se, 6) AS standard_error, round(lo, 6) AS minimum, round(hi, 6) AS maximum, k AS predicted_positive_count, n - k AS predicted_negative_count, round(r, 6) AS predicted_positive_rate, round(100.0 * r, 6) AS predicted_positive_rate_percent, round(bv, 6) AS bernoulli_sample_variance, round(m - {_Z} * se, 6) AS mean_low, round(m + {_Z} * se, 6) AS mean_high, {_WL} AS rate_low, {_WH} AS rate_high FROM e")
def group_summary(spark, sf_dir):
    return rounded(audit.group_summary(decided(spark, sf_dir), "lang"))


@query(f"WITH {SQL_DECIDED}, l7 AS (SELECT unnest({list(audit.LEVELS)}) AS level), g AS (SELECT lang, quantile_cont(m, {list(audit.LEVELS)}) AS v FROM q GROUP BY lang) SELECT lang, unnest({list(audit.LEVELS)})::DOUBLE AS level, round(unnest(v), 6) AS value FROM g")
def group_quantiles(spark, sf_dir):
    return rounded(audit.group_quantiles(decided(spark, sf_dir), "lang"))


@query(f"{_SUMMARY} SELECT lang, {_WL} AS rate_low, {_WH} AS rate_high FROM e")
def wilson_ci(spark, sf_dir):
    own = decided(spark, sf_dir).groupBy("lang").agg(F.sum("prediction").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return rounded(own.select("lang", low.alias("rate_low"), high.alias("rate_high")))


@query(f"{_SUMMARY} SELECT lang, round(m - {_Z} * se, 6) AS mean_low, round(m + {_Z} * se, 6) AS mean_high FROM e")
def normal_ci(spark, sf_dir):
    return rounded(audit.group_summary(decided(spark, sf_dir), "lang").select("lang", "mean_low", "mean_high"))


_PAIRS = f"WITH {SQL_DECIDED}, g AS (SELECT lang, avg(m) AS m, var_samp(m) AS v, count(*) AS n, avg(prediction) AS r FROM q GROUP BY lang), p AS (SELECT x.lang AS first_group, y.lang AS second_group, x.m - y.m AS dm, x.r - y.r AS dr, ((x.n - 1) * x.v + (y.n - 1) * y.v) / (x.n + y.n - 2) AS pv FROM g x JOIN g y ON x.lang < y.lang)"


@query(f"{_PAIRS} SELECT first_group, second_group, round(dm / sqrt(pv), 6) AS cohens_d FROM p")
def cohens_d_pairs(spark, sf_dir):
    return rounded(audit.pairwise(decided(spark, sf_dir), "lang").select("first_group", "second_group", "cohens_d"))


@query(f"{_PAIRS} SELECT first_group, second_group, round(dm, 6) AS mean_difference, round(dr, 6) AS rate_difference FROM p")
def pairwise_mean_diff(spark, sf_dir):
    return rounded(audit.pairwise(decided(spark, sf_dir), "lang").select("first_group", "second_group", "mean_difference", "rate_difference"))


@query(f"WITH {SQL_DECIDED}, x AS (SELECT DISTINCT CASE WHEN lang = 'en' THEN 0.5 ELSE 0.6 END AS t FROM q) SELECT count(*) AS thresholds FROM x HAVING count(*) > 1")
def threshold_conflicts(spark, sf_dir):
    """One group decided by another threshold."""
    other = F.when(F.col("lang") == "en", 0.5).otherwise(0.6)
    return audit.threshold_conflicts(A.decide(scored_articles(spark, sf_dir), other))


def _mixed_sql(x: str, name: str) -> str:
    """Steps of audit's mixing of 31-bit numbers as nested selects: columns of the table `name`, with x mixed as h."""
    rows = f"SELECT * EXCLUDE (h), xor(h, h >> 16) AS h FROM (SELECT *, {x} AS h FROM {name})"
    for k in range(2):
        rows = f"SELECT * EXCLUDE (h), (h * {shuffle.FACTOR}) & {shuffle.MASK} AS h FROM ({rows})"
        rows = f"SELECT * EXCLUDE (h), xor(h, h >> 16) AS h FROM ({rows})"
    return rows


def _boot(values: str) -> str:
    return f"""v AS ({values}), b AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY md5(id::VARCHAR)) - 1 AS i FROM v), n AS (SELECT g, count(*) AS n, ('0x' || substr(md5('42:' || g), 1, 7))::BIGINT AS key FROM v GROUP BY g),
rp AS (SELECT g, n, key, r.range AS replicate FROM n, range({REPLICATES}) r),
ky AS (SELECT g, n, replicate, h AS key FROM ({_mixed_sql('xor(key, replicate)', 'rp')})),
dr AS (SELECT g, n, replicate, key, unnest(range(0, n)) AS draw FROM ky),
ix AS (SELECT g, replicate, h % n AS i FROM ({_mixed_sql('xor(key, draw)', 'dr')})),
me AS (SELECT g, replicate, avg(x) AS m, var_samp(x) AS vr FROM ix JOIN b USING (g, i) GROUP BY g, replicate)"""


LEAF = 16  # values of a leaf in the query over ranges


def _boot_by_ranges(values: str, replicates: int, leaf: int) -> str:
    """SQL of replicates whose counts are split down a tree of ranges: ct has the distribution function of each split and total as a list."""
    sql = lambda x, name: _mixed_sql(x, name)
    node = "(SELECT *, (first + last) // 2 AS middle FROM nd WHERE last - first > 1)"
    number = f"SELECT * EXCLUDE (h), h AS high FROM ({sql('xor(key, 3)', 'n1')})"
    lower = f"SELECT * EXCLUDE (h), (high::DOUBLE * 2147483648.0 + h) / 4611686018427387904.0 AS u FROM ({sql('xor(key, 4)', 'n2')})"
    seeds = f"SELECT * EXCLUDE (h), h AS lkey FROM ({sql('xor(key, 1)', 'n4')})"
    return f"""v AS ({values}), b AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY md5(id::VARCHAR)) - 1 AS i FROM v), n AS (SELECT g, count(*) AS n, ('0x' || substr(md5('42:' || g), 1, 7))::BIGINT AS key FROM v GROUP BY g),
rp AS (SELECT g, n, key, r.range AS replicate FROM n, range({replicates}) r),
sp AS (SELECT g, n, 0::BIGINT AS first, ceil(n / {leaf})::BIGINT AS last FROM n UNION ALL SELECT g, n, unnest([first, (first + last) // 2]), unnest([(first + last) // 2, last]) FROM sp WHERE last - first > 1),
pr AS (SELECT DISTINCT n, ((first + last) // 2 - first) * {leaf} / (least(last * {leaf}, n) - first * {leaf})::DOUBLE AS p FROM sp WHERE last - first > 1),
pk AS (SELECT p, t, unnest(range(0, t + 1)) AS k FROM (SELECT p, unnest(range(0, n + 1)) AS t FROM (SELECT p, max(n) AS n FROM pr GROUP BY p))),
pc AS (SELECT p, t, k, sum(exp(lgamma(t + 1) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END - CASE WHEN k = t THEN 0 ELSE lgamma(t - k + 1) END + k * ln(p) + (t - k) * ln(1 - p))) OVER (PARTITION BY p, t ORDER BY k ROWS UNBOUNDED PRECEDING) AS c FROM pk WHERE t > 0),
ct AS MATERIALIZED (SELECT p, t, list(c ORDER BY k) AS cs FROM pc GROUP BY p, t UNION ALL SELECT DISTINCT p, 0, [1.0::DOUBLE] FROM pr),
nd AS (SELECT g, n, replicate, 0::BIGINT AS first, ceil(n / {leaf})::BIGINT AS last, n AS total, h AS key FROM ({sql('xor(key, replicate)', 'rp')})
UNION ALL SELECT g, n, replicate, unnest([first, middle]), unnest([middle, last]), unnest([k, total - k]), unnest([lkey, h])
FROM (WITH n0 AS {node}, n1 AS (SELECT * FROM n0), n2 AS ({number}), n3 AS (SELECT n2u.*, least(len(list_filter(cs, lambda y: y < u)), total)::BIGINT AS k FROM ({lower}) n2u JOIN ct ON ct.t = total AND ct.p = (middle - first) * {leaf} / (least(last * {leaf}, n) - first * {leaf})::DOUBLE),
n4 AS (SELECT * FROM n3), n5 AS ({seeds}) SELECT * FROM ({sql('xor(key, 2)', 'n5')}))),
lf AS (SELECT g, n, replicate, first, key, least({leaf}, n - first * {leaf}) AS size, unnest(range(0, total)) AS draw FROM nd WHERE last - first = 1),
ix AS (SELECT g, replicate, first * {leaf} + h % size AS i FROM ({sql('xor(key, draw)', 'lf')})),
me AS (SELECT g, replicate, avg(x) AS m, var_samp(x) AS vr FROM ix JOIN b USING (g, i) GROUP BY g, replicate)"""


_SCORES = "SELECT lang AS g, m AS x, pmid AS id FROM q"


@query(f"WITH {SQL_DECIDED}, {_boot(_SCORES)} SELECT g AS lang, round(quantile_cont(m, 0.025), 6) AS mean_low, round(quantile_cont(m, 0.975), 6) AS mean_high, round(quantile_cont(vr, 0.025), 6) AS variance_low, round(quantile_cont(vr, 0.975), 6) AS variance_high FROM me GROUP BY g")
def bootstrap_mean_ci(spark, sf_dir):
    return rounded(audit.bootstrap(decided(spark, sf_dir), "lang", "mean_positive_probability", DRAWN))


@query(f"WITH RECURSIVE {SQL_DECIDED}, {_boot_by_ranges(_SCORES, 1000, LEAF)} SELECT g AS lang, round(quantile_cont(m, 0.025), 6) AS mean_low, round(quantile_cont(m, 0.975), 6) AS mean_high, round(quantile_cont(vr, 0.025), 6) AS variance_low, round(quantile_cont(vr, 0.975), 6) AS variance_high FROM me GROUP BY g")
def bootstrap_by_ranges(spark, sf_dir):
    """Replicates of groups that are cut into many leaves: counts are split down a tree of ranges."""
    return rounded(audit.bootstrap(decided(spark, sf_dir), "lang", "mean_positive_probability", 1000, leaf=LEAF))


@query(f"WITH {SQL_DECIDED}, {_boot(_SCORES)} SELECT x.g AS first_group, y.g AS second_group, round(quantile_cont(x.m - y.m, 0.025), 6) AS low, round(quantile_cont(x.m - y.m, 0.975), 6) AS high FROM me x JOIN me y ON x.replicate = y.replicate AND x.g < y.g GROUP BY ALL")
def bootstrap_diff_ci(spark, sf_dir):
    return rounded(audit.bootstrap_differences(decided(spark, sf_dir), "lang", "mean_positive_probability", DRAWN))


def _styled(spark, sf_dir):
    """Turns of conversations as paired records: a pair is two turns after each other, user A, assistant B."""
    turns = table(spark, sf_dir, "conversations")
    score = scoring.surrogate(F.col("conv_id"), F.col("turn"))
    return turns.select(F.expr("conv_id % 4").alias("experiment"), F.concat_ws("-", "conv_id", F.expr("turn div 2")).alias("pair_id"), F.when(F.expr("turn % 2 = 0"), "A").otherwise("B").alias("style"), (score >= F.when(F.expr("turn % 2 = 0"), 0.4).otherwise(0.6)).cast("int").alias("prediction"), "role")


_STYLED = "WITH t AS (SELECT conv_id % 4 AS experiment, conv_id || '-' || (turn // 2) AS pair_id, CASE WHEN turn % 2 = 0 THEN 'A' ELSE 'B' END AS style, role, ((('0x' || substr(md5(conv_id || ':' || turn), 1, 8))::BIGINT::DOUBLE / 4294967295.0) >= CASE WHEN turn % 2 = 0 THEN 0.4 ELSE 0.6 END)::INTEGER AS prediction FROM conversations)"
_COMPLETE = ", o AS (SELECT experiment, pair_id, max(prediction) FILTER (style = 'A') AS a, max(prediction) FILTER (style = 'B') AS b FROM t GROUP BY experiment, pair_id HAVING count(*) = 2 AND count(DISTINCT style) = 2)"


@query(f"{_STYLED} SELECT experiment, count(*) FILTER (style = 'A') AS n_a, round(avg(prediction) FILTER (style = 'A'), 6) AS rate_a, count(*) FILTER (style = 'B') AS n_b, round(avg(prediction) FILTER (style = 'B'), 6) AS rate_b, round(avg(prediction) FILTER (style = 'A') / nullif(avg(prediction) FILTER (style = 'B'), 0), 6) AS ratio FROM t GROUP BY experiment")
def style_positive_rate(spark, sf_dir):
    return rounded(audit.style_rates(_styled(spark, sf_dir), "experiment", "style"))


@query(f"{_STYLED}{_COMPLETE} SELECT experiment, count(*) FILTER (a = 1 AND b = 0) AS a_only, count(*) FILTER (a = 0 AND b = 1) AS b_only, count(*) FILTER (a = 1 AND b = 1) AS both, count(*) FILTER (a = 0 AND b = 0) AS neither, count(*) AS total_pairs FROM o GROUP BY experiment")
def paired_outcomes(spark, sf_dir):
    return audit.paired_outcomes(_styled(spark, sf_dir), "experiment", "pair_id", "style")


@query(f"{_STYLED} SELECT pair_id, count(*) AS n_rows, count(*) FILTER (style = 'A') AS n_a, count(*) FILTER (style = 'B') AS n_b FROM t GROUP BY pair_id HAVING count(*) <> 2 OR count(*) FILTER (style = 'A') <> 1 OR count(*) FILTER (style = 'B') <> 1")
def pair_completeness(spark, sf_dir):
    return audit.pair_violations(_styled(spark, sf_dir), "pair_id", "style")


@query(f"{_STYLED}{_COMPLETE}, {_boot('SELECT ' + chr(39) + 'pairs' + chr(39) + ' AS g, (a - b)::DOUBLE AS x, pair_id AS id FROM o')} SELECT round(quantile_cont(m, 0.025), 6) AS mean_low, round(quantile_cont(m, 0.975), 6) AS mean_high FROM me")
def paired_bootstrap(spark, sf_dir):
    own = _styled(spark, sf_dir).groupBy("pair_id").agg(F.count("*").alias("n"), *(F.max(F.when(F.col("style") == s, F.col("prediction"))).alias(s) for s in "AB"))
    return rounded(audit.paired_bootstrap(own.where("n = 2 and A is not null and B is not null"), "pair_id", "A", "B", DRAWN))


@query("WITH g AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, source, n, round(n / sum(n) OVER (PARTITION BY lang), 6) AS share FROM g")
def group_balance(spark, sf_dir):
    return rounded(audit.balance(table(spark, sf_dir, "documents"), "lang", "source"))


@query(f"WITH {SQL_DECIDED}, p AS (SELECT count(*) AS positives, count(*) FILTER (prediction = 1) AS tp FROM q WHERE label = 1), g AS (SELECT lang, count(*) AS negatives, count(*) FILTER (prediction = 0) AS tn FROM q WHERE label = 0 GROUP BY lang) SELECT lang, negatives, positives, round((tn + tp) / (negatives + positives), 6) AS accuracy, round(tp / positives, 6) AS sensitivity, round(tn / negatives, 6) AS specificity FROM g, p")
def combined_audit(spark, sf_dir):
    return rounded(audit.combined(decided(spark, sf_dir), "lang"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '<[^>]*>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS title, array_to_string(list_transform(regexp_extract_all(html, '(?s)<p>(.*?)(?:</p>|<br>)', 1), lambda x: regexp_replace(x, '<[^>]*>', '', 'g')), chr(10)) AS body FROM pages")
def html_title_extract(spark, sf_dir):
    """Title and paragraphs of marked-up pages, paragraphs on lines of their own."""
    strip = lambda x: F.regexp_replace(x, "<[^>]*>", "")
    title = F.regexp_replace(strip(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)), r"^\s+|\s+$", "")
    body = F.array_join(F.transform(F.regexp_extract_all("html", F.lit("(?s)<p>(.*?)(?:</p>|<br>)"), F.lit(1)), strip), "\n")
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), body.alias("body"))


@query(rf"""WITH {SQL_ARTICLES}, tt AS (SELECT count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM a),
k AS (SELECT m AS s FROM a UNION SELECT 0.0 UNION SELECT 1.0),
v AS (SELECT s, (SELECT count(*) FROM a WHERE label = 1 AND m >= s) AS tp, (SELECT count(*) FROM a WHERE label = 0 AND m >= s) AS fp FROM k),
b AS (SELECT s AS t FROM v, tt ORDER BY tp / p + (n - fp) / n - 1.0 DESC, (n - fp) / n DESC, tp / p DESC, s DESC LIMIT 1),
e AS (SELECT lang, count(*) AS n, avg(m) AS mean, sum((m >= t)::INTEGER)::BIGINT AS k, any_value(t) AS t, sum((m >= t)::INTEGER) / count(*) AS r FROM a, b GROUP BY lang)
SELECT lang, n AS n_articles, round(mean, 6) AS mean, round(t, 6) AS threshold, k AS positives, round(r, 6) AS rate, {_WL} AS rate_low, {_WH} AS rate_high FROM e""")
def fairness_audit(spark, sf_dir):
    """The flagship: windows, scores, article means, a threshold by Youden's index, then for each language the positive rate
    with its interval."""
    scored = materialized(scored_articles(spark, sf_dir), "articles")
    cut = A.choose_threshold(scored).select("threshold").withColumn("_one", F.lit(1))  # one row
    rows = A.decide(scored.withColumn("_one", F.lit(1)).join(F.broadcast(cut), "_one"), F.col("threshold"))
    out = rows.groupBy("lang").agg(F.count("*").alias("n_articles"), F.avg("mean_positive_probability").alias("mean"), F.first("threshold").alias("threshold"), F.sum("prediction").cast("long").alias("positives"))
    low, high = stats.wilson(F.col("positives"), F.col("n_articles"))
    return rounded(out.select("*", stats.ratio(F.col("positives"), F.col("n_articles")).alias("rate"), low.alias("rate_low"), high.alias("rate_high")))


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 6) AS mean_chars FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_lang_source(spark, sf_dir):
    """An extension beyond the audit's own groups."""
    return rounded(table(spark, sf_dir, "documents").rollup("lang", "source").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars")))


@query()
def spark_ml_scorer(spark, sf_dir):
    return scoring.learned_scorer(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

"""Article scores from a growing folder of window predictions.

The batch operators need no stream; this keeps article means up to date as prediction files arrive. Each micro-batch is
pre-aggregated by article and appended as one table of sums; reading adds them up, so a batch is written once, under its number,
and a repeated batch replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "pmid string, chunk_index int, label int, positive_probability double"


def start(spark: SparkSession, source: str, target: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Follows Parquet files of window predictions in `source`; sums go to `target`/batch=N."""

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("pmid").agg(F.max("label").alias("label"), F.count("*").alias("n"), F.sum("positive_probability").alias("total"))
        sums.write.mode("overwrite").parquet(f"{target}/batch={number}")

    writer = spark.readStream.schema(SCHEMA).parquet(source).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def article_scores(spark: SparkSession, target: str) -> DataFrame:
    """(pmid, label, n_chunks, mean_positive_probability) of all batches so far."""
    sums = spark.read.parquet(target).groupBy("pmid").agg(F.max("label").alias("label"), F.sum("n").alias("n_chunks"), F.sum("total").alias("total"))
    return sums.select("pmid", "label", "n_chunks", (F.col("total") / F.col("n_chunks")).alias("mean_positive_probability"))

"""Shared folders, and connected components without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import drop, scratch, shared_dir

__all__ = ["components", "drop", "forget", "quoted", "scratch", "shared_dir", "written"]


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and survives the loss of executors. by: a column of
    integers with few values, each of which gets a folder of its own."""
    spark = df.sparkSession
    path = scratch(spark, name)
    writer = df.write if by is None else df.write.partitionBy(by).option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def quoted(name: str) -> str:
    """A column's name as select() takes it, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def forget(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for x in tables:
        drop(x.sparkSession, x.written_to)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links(a, b): component is the smallest node that links reach.

    Alternating large-star and small-star steps: each is an aggregation with map-side partial minima and an equi-join;
    the links left after a round are written to the shared folder. A node with many links spreads over tasks in the
    aggregation; the join side that holds minima has one row a node. Without links there are no rows.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = written(edges, "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state or not state[0]:
            break
        before = state
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        done, edges = edges, written(small.where("u <> v").distinct(), "edges")
        forget(done)
    tops = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(tops)

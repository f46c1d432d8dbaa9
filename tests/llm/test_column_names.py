"""Stages of the pipeline pass columns of any name on, with their values."""

from pyspark.sql import functions as F

from veriscreen.llm import decontam, jaccard, mixing, toxicity

NAMES = ["a.b", "a`b", "all", "row", "score", "tokens", "n"]


def documents(spark):
    rows = [(k, f"one two three four five six seven {k % 7} eight nine ten", f"s{k % 3}", *(f"{name}{k}" for name in NAMES)) for k in range(21)]
    rows += [(100, None, None, *[None] * len(NAMES)), (None, "", "s1", *["x"] * len(NAMES))]
    return spark.createDataFrame(rows, ["doc_id", "text", "source", *NAMES])


def kept(docs, out):
    """Rows of out are rows of docs."""
    assert out.columns == docs.columns
    whole = {tuple(r) for r in docs.collect()}
    got = [tuple(r) for r in out.collect()]
    assert got and set(got) <= whole
    return got


def test_stages(spark):
    docs = documents(spark)
    labels = docs.where("doc_id is not null").select("doc_id", F.lit(0).alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    model = toxicity.fit(docs.select("doc_id", "text"), labels)
    kept(docs, toxicity.keep_below(docs, model, 2.0))
    assert len(kept(docs, jaccard.keep_first(docs))) == 9  # seven texts, and two rows without words
    items = spark.createDataFrame([(1, "three four five six seven 0 eight")], "item_id long, text string")
    assert len(kept(docs, decontam.clean(docs, items, short_runs=True))) == 20
    kept(docs, mixing.taken(docs).select("all.*"))
    assert mixing.mix(docs).columns == [*docs.columns, "_tokens", "_pass", "_block", "_place"]

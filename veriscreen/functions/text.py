"""Text to tokens to overlapping windows, with built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLS, SEP, PAD = 101, 102, 0
SPACES = r"[ \t\n\r\f]+"
TEXT = r"[^\s\p{Z}\x{1C}-\x{1F}\x{85}]"  # anything but Unicode white space


def stripped(c: Column) -> Column:
    """Text without Unicode white space at its ends; null stays null."""
    return F.regexp_replace(c, r"^[\s\p{Z}\x{1C}-\x{1F}\x{85}]+|[\s\p{Z}\x{1C}-\x{1F}\x{85}]+\z", "")


def clean_id(c: Column) -> Column:
    """An identifier as text without Unicode white space at its ends; null stays null."""
    return stripped(c.cast("string"))


def compose(title: Column, abstract: Column) -> Column:
    """Title and abstract as one text, without white space at their ends and with an empty line between."""
    return F.concat(stripped(title), F.lit("\n\n"), stripped(abstract))


def tokens(text: Column) -> Column:
    """Lower-cased words."""
    return F.filter(F.split(F.lower(text), SPACES), lambda x: x != "")


def window_count(n: Column, cap: int, overlap: int) -> Column:
    """How many windows of cap tokens, overlapping by overlap, n tokens have: none for none, and no window that only
    repeats the end of the one before."""
    check_windows(cap, overlap)
    step = cap - overlap
    return F.when(n <= 0, 0).when(n <= cap, 1).otherwise(F.floor((n - cap + step - 1) / step) + 1).cast("int")


def check_windows(cap: int, overlap: int) -> None:
    if cap < 1 or not 0 <= overlap < cap:
        raise ValueError("window length must leave room for two special tokens, and the overlap must be shorter")


def windows(df: DataFrame, ids: str, max_length: int, overlap: int) -> DataFrame:
    """A row for each window of the array column `ids`: chunk_index and the window's tokens as chunk, without special
    tokens, for which two of max_length places are kept."""
    cap = max_length - 2
    check_windows(cap, overlap)
    count = window_count(F.size(ids), cap, overlap)
    spread = df.withColumn("_k", count).where("_k > 0").withColumn("chunk_index", F.explode(F.sequence(F.lit(0), F.col("_k") - 1))).drop("_k")
    return spread.withColumn("chunk", F.slice(F.col(ids), F.col("chunk_index") * (cap - overlap) + 1, F.lit(cap)))


def wrap(ids: Column, cls: int = CLS, sep: int = SEP) -> tuple[Column, Column, Column]:
    """Input ids with special tokens, a mask of ones and types of zeros."""
    whole = F.concat(F.array(F.lit(cls)), ids, F.array(F.lit(sep)))
    return whole, F.array_repeat(F.lit(1), F.size(ids) + 2), F.array_repeat(F.lit(0), F.size(ids) + 2)


def pad(ids: Column, length: Column, value: int = PAD) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(value), length - F.size(ids)))


def pad_batches(df: DataFrame, batch: str, ids: str) -> DataFrame:
    """Rows padded to the longest of their batch, with mask and types; the lengths of a batch meet as one number."""
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("batch_length"))
    out = df.join(longest, batch)
    size = F.size(ids)
    return out.withColumns({
        "attention_mask": F.concat(F.array_repeat(F.lit(1), size), F.array_repeat(F.lit(0), F.col("batch_length") - size)),
        "token_type_ids": F.array_repeat(F.lit(0), F.col("batch_length")),
        ids: pad(F.col(ids), F.col("batch_length")),
    })

"""JSON documents of any size: the elements of their arrays as rows, read and written in parallel.

A document is one object with arrays of objects beside smaller fields. It is read as text cut behind closing braces, in splits as Spark makes them. What a
split means depends on what stands before it, so it is scanned twice. First each split reports how it maps states: whether its quotes are
odd in number, and how much deeper it ends if it begins outside a string, or inside one. These maps compose: two running
sums over splits give each one its beginning. Then each split, knowing where it begins, gives the elements that lie in it whole as rows, and the
ends of those that go over its borders, of which each split has two at most; these meet afterwards. What is left of the document without the elements is its
outline, a small document by itself.

Texts are bytes to no one here: strings may hold braces, brackets and escaped quotes. Elements that are no objects, and deeper fields beside
the arrays, are left out of the outline.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage
from .scratch import drop, materialized, scratch

_TOKENS = re.compile(r'\\.|["{}\[\]]', re.DOTALL)
_STATES = "path string, block long, odd int, outside long, inside long"
_PARTS = "path string, block long, seq long, kind string, key string, value string"


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(path, block, value) in the order of the document; a closing brace follows each value."""
    return spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[tuple, Iterator[str]]]:
    """(path, block and what else stands before the value; values) of each split."""
    from itertools import chain, groupby

    rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns)) for b in batches)
    for head, own in groupby(rows, key=lambda r: r[:width]):
        yield head, (f"{r[width]}}}" for r in own)


def _mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How each split maps the state that it begins with."""
    out = []
    for (path, block), pieces in _runs(batches, 2):
        odd, deeper = 0, [0, 0]  # if it begins outside a string, or inside one
        for piece in pieces:
            for token in _TOKENS.finditer(piece):
                c = token[0]
                if c == '"':
                    odd ^= 1
                elif len(c) == 1:
                    deeper[odd] += 1 if c in "{[" else -1
        out.append((path, block, odd, *deeper))
    if out:
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["path", "block", "odd", "outside", "inside"])


class _Split:
    """The scan of a split from a known state. Depth 1 is the document's object, 2 its arrays, 3 their elements."""

    def __init__(self, path: str, block: int, quoted: int, depth: int):
        self.head, self.quoted, self.depth = (path, block), quoted, depth
        self.rows, self.outline, self.text, self.string = [], [], [], []
        self.begun = depth >= 3  # an element goes on from before
        self.key: str | None = None  # of the array that is open; None as long as it is one from before
        self.name = ""

    def row(self, kind: str, value: str, key: str | None = None) -> None:
        self.rows.append((*self.head, len(self.rows), kind, key, value))

    def scan(self, piece: str) -> None:
        at, took = 0, 0  # `took`: up to where the text of an element or the outline is taken over
        for token in _TOKENS.finditer(piece):
            c, at = token[0], token.start()
            if c == '"':
                if self.quoted:
                    if self.depth == 1:
                        self.name = "".join([*self.string, piece[took if self.string else self.opened : at]])
                    self.string = []
                else:
                    self.opened = at + 1
                self.quoted ^= 1
            elif len(c) > 1 or self.quoted:
                continue
            elif c in "{[":
                self.depth += 1
                if self.depth == 2:
                    self.outline.append(piece[took : at + 1])
                    took = at + 1
                    self.key = self.name if c == "[" else ""
                elif self.depth == 3:
                    took = at
                    self.text = []
            else:
                self.depth -= 1
                if self.depth == 2:
                    self.text.append(piece[took : at + 1])
                    self.row("head" if self.begun else "whole", "".join(self.text), self.key)
                    self.begun, self.text, took = False, [], at + 1
                elif self.depth == 1:
                    took = at
                    self.key = ""
        rest = piece[took:]
        if self.depth >= 3:
            self.text.append(rest)
        elif self.depth <= 1:
            self.outline.append(rest)
        if self.quoted and self.depth == 1:  # a string with a brace in it
            self.string.append(piece[self.opened :] if not self.string else piece)
            self.opened = 0

    opened = 0

    def finish(self) -> list[tuple]:
        if self.depth >= 3:
            self.row("middle" if self.begun else "tail", "".join(self.text), self.key)
        self.row("outline", "".join(self.outline))
        self.row("key", "", self.key)
        return self.rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for (path, block, quoted, depth), pieces in _runs(batches, 4):
        split, ready = _Split(path, block, quoted, depth), 0
        for piece in pieces:
            split.scan(piece)
            if len(split.rows) - ready >= 4096:
                yield _batch(split.rows[ready:])
                split.rows[ready:] = [None] * (len(split.rows) - ready)  # only their number goes on
                ready = len(split.rows)
        yield _batch(split.finish()[ready:])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["path", "block", "seq", "kind", "key", "value"])


def elements(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, dict]]:
    """(path, key, value) of the elements of all arrays of one or more documents, and the outline of each document. ValueError for what is not a whole document."""
    pieces = _pieces(spark, path)
    states = materialized(pieces.mapInArrow(_mapped, _STATES), "splits")  # a row a split
    order = Window.partitionBy("path").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    states = states.withColumn("quoted", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    states = states.withColumn("more", F.when(F.col("quoted") == 0, F.col("outside")).otherwise(F.col("inside")))
    states = states.withColumn("depth", F.coalesce(F.sum("more").over(before), F.lit(0)))
    ends = states.groupBy("path").agg(F.sum("more").alias("depth"), (F.sum("odd") % 2).alias("odd"))
    if bad := ends.where("odd <> 0 or depth not in (0, -1)").limit(5).collect():  # a brace is added behind the last one
        raise ValueError(f"not a whole JSON document: {', '.join(r.path for r in bad)}")
    starts = F.broadcast(states.select("path", "block", F.col("quoted").cast("int").alias("quoted"), "depth"))  # a row for each split of a file
    known = pieces.join(starts, ["path", "block"]).select("path", "block", "quoted", "depth", "value")
    parts = materialized(known.mapInArrow(_cut, _PARTS), "elements")
    few = parts.where("kind <> 'whole'")  # a handful a split
    keys = few.where("kind = 'key'").withColumn("open", F.last("key", ignorenulls=True).over(before)).select("path", "block", "open")
    own = F.coalesce("key", "open").alias("key")
    whole = parts.where("kind = 'whole'").join(F.broadcast(keys), ["path", "block"]).select("path", own, "value")
    torn = few.where("kind in ('tail', 'middle', 'head')").join(F.broadcast(keys), ["path", "block"])
    number = F.sum(F.when(F.col("kind") == "tail", 1).otherwise(0)).over(Window.partitionBy("path").orderBy("block", "seq"))
    torn = torn.withColumn("number", number).groupBy("path", "number").agg(F.array_sort(F.collect_list(F.struct("block", "seq", own, "value"))).alias("p"))  # the parts of one element
    torn = torn.select("path", F.col("p")[0]["key"].alias("key"), F.array_join(F.transform("p", lambda x: x["value"]), "").alias("value"))
    outlines: dict[str, str] = {}
    for r in few.where("kind = 'outline' and value <> ''").orderBy("path", "block").collect():  # what is beside the arrays
        outlines[r.path] = outlines.get(r.path, "") + r.value
    return whole.union(torn), {k: _outline(k, v) for k, v in outlines.items()}


def _outline(path: str, text: str) -> dict:
    text = text.strip().removeprefix("\ufeff")
    for own in (text, text[:-1].rstrip() if text.endswith("}") else text):  # the brace that reading has added
        try:
            found = json.loads(own)
        except ValueError:
            continue
        if isinstance(found, dict):
            return found
    raise ValueError(f"{path}: no JSON object")


def array(spark: SparkSession, path: str, key: str, schema: str) -> tuple[DataFrame, dict[str, dict]]:
    """The elements of the array `key` as columns of schema (DDL), and the outlines. ValueError where there is no such array, or an element does not parse."""
    rows, outlines = elements(spark, path)
    for name, own in outlines.items():
        if not isinstance(own.get(key), list):
            raise ValueError(f"{name} has no list {key!r}")
    own = T.StructType.fromDDL(f"{schema}, _corrupt string")
    parsed = F.from_json("value", own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = rows.where(F.col("key") == key).select("path", F.when(parsed["_corrupt"].isNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("no JSON object: "), F.substring("value", 1, 200)))).alias("x"))
    return rows.select("path", *(F.col("x")[f.name].alias(f.name) for f in own.fields[:-1])), outlines


def write(path: str, head: dict, arrays: dict[str, tuple[DataFrame, list]]) -> None:
    """A new document of the fields of head, and for each array the rows of a DataFrame in an order; rows of one column `value` are plain values, others
    objects. Parts are sorted and written by tasks, and copied one behind the other."""
    parts, folders = [json.dumps(head, ensure_ascii=False, indent=2, allow_nan=False).rstrip("}").rstrip().encode()], []
    for key, (rows, order) in arrays.items():
        folder = scratch(rows.sparkSession, "document")
        if rows.columns == ["value"]:
            line = F.regexp_replace(F.to_json(F.array("value")), r"^\[|\]\z", "")
        else:
            line = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
        rows.orderBy(*order).select(F.concat(F.lit(","), line).alias("value")).write.text(folder)
        parts[-1] += f"{',' if head or folders else ''}\n  {json.dumps(key)}: [\n".encode()
        parts.append(b"]")
        folders.append(folder)
    parts[-1] += b"\n}\n"
    storage.stitch(path, parts, folders, skip=1)
    for (rows, _), folder in zip(arrays.values(), folders):
        drop(rows.sparkSession, folder)

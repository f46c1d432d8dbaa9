"""Bibliographic XML to article rows, and request batches for a fetch service."""

from __future__ import annotations

import io
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _text(element: ElementTree.Element | None) -> str:
    """All text within an element, in order, without white space at the ends."""
    return "" if element is None else "".join(element.itertext()).strip()


def _articles(document: str) -> Iterator[tuple[str, str, str]]:
    """(pmid, title, abstract) of a document's articles, one after the other."""
    depth = 0
    for event, element in ElementTree.iterparse(io.BytesIO(document.encode("utf-8")), events=("start", "end")):
        if event == "start":
            depth += 1
            continue
        depth -= 1
        if element.tag == "ERROR":
            raise ValueError(f"the service reports: {_text(element)}")
        if depth == 1:
            if element.tag == "PubmedArticle":
                citation = element.find("MedlineCitation")
                article = None if citation is None else citation.find("Article")
                if article is None:
                    raise ValueError("an article without a citation")
                yield _text(citation.find("PMID")), _text(article.find("ArticleTitle")), "\n".join(map(_text, article.findall("Abstract/AbstractText")))
            element.clear()


def parse_articles(documents: DataFrame, label: int, xml: str = "xml") -> DataFrame:
    """(pmid, title, abstract, label) of all articles in XML documents, as an XML parser reads them: text of nested markup is kept in order, character
    data and references count, comments do not. Sections of an abstract are joined by line feeds, a missing abstract is empty. A
    document with an ERROR element, or that is not well-formed, raises. A document is read article by article; null documents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for document in batch.column(0).to_pylist():
                rows = [] if document is None else list(_articles(document))
                yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.string()) for k in range(3)), pa.array([label] * len(rows), pa.int32())], ["pmid", "title", "abstract", "label"])

    return documents.select(F.col(xml).alias("xml")).mapInArrow(run, "pmid string, title string, abstract string, label int")


def missing_abstracts(articles: DataFrame) -> DataFrame:
    return articles.where("abstract = ''").select("pmid")


def request_batches(ids: DataFrame, size: int = 100, key: str = "pmid") -> DataFrame:
    """(batch, ids): different ids in numeric order, `size` a request. They are numbered within parts by length and first
    digits; only the counts of parts meet in one window."""
    if not 1 <= size <= 200:
        raise ValueError("a request takes 1 to 200 ids")
    own = ids.select(F.col(key).cast("string").alias(key)).distinct().withColumn("part", F.format_string("%04d%s", F.length(key), F.substring(key, 1, 3)))
    parts = own.groupBy("part").agg(F.count("*").alias("n"))  # a row for each length and three digits
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    placed = own.withColumn("place", place).join(parts, "part")
    batch = F.floor((F.col("before") + F.col("place")) / size)
    by_number = F.array_sort(F.collect_list(F.struct(F.length(key).alias("digits"), F.col(key).alias("id"))))
    return placed.groupBy(batch.alias("batch")).agg(F.transform(by_number, lambda x: x["id"]).alias("ids"))


def returned_differences(requested: DataFrame, returned: DataFrame, key: str = "pmid") -> DataFrame:
    """Ids that were requested and not returned, or the other way round."""
    a, b = requested.select(key).distinct(), returned.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("missing")).union(b.join(a, key, "left_anti").withColumn("side", F.lit("unexpected")))

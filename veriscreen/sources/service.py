"""A paged service as a source: requests are rows, tasks send them, and responses are a table that a later run goes on from."""

from __future__ import annotations

import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage

#: Fixed value: the public service for records by id.
ENDPOINT = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils/efetch.fcgi"
RESPONSES = "batch long, attempts int, xml string"
WAVE = 64  # requests that are kept at once: what an interrupted run loses at most


def http_client(endpoint: str, email: str, timeout: float = 60.0, tool: str = "veriscreen") -> Callable[[Sequence[str]], str]:
    """A client for fetched(): posts the ids of a request, and waits at most `timeout` seconds for an answer."""

    def client(ids: Sequence[str]) -> str:
        data = urllib.parse.urlencode({"db": "pubmed", "id": ",".join(ids), "retmode": "xml", "tool": tool, "email": email}).encode()
        request = urllib.request.Request(endpoint, data=data, headers={"User-Agent": f"{tool}/1.0"})
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return response.read().decode("utf-8")

    return client


def fetched(batches: DataFrame, client: Callable[[Sequence[str]], str], *, lanes: int = 1, pause: float = 0.4, retries: int = 3) -> DataFrame:
    """(batch, attempts, xml) of batches(batch, ids): each of `lanes` tasks sends its requests one after the other, with a pause of so many seconds
    behind each. A request that fails is sent again `retries` times, after twice the pause each time; then the run fails. The service sees lanes / pause requests a second at most."""
    if lanes < 1 or pause < 0 or retries < 0:
        raise ValueError("lanes must be positive, pause and retries not negative")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids in ((b, i) for rows_ in rows for b, i in zip(*(c.to_pylist() for c in rows_.columns))):
            wait = pause
            for attempt in range(1, retries + 2):
                try:
                    xml = client(ids)
                    break
                except Exception as error:
                    if attempt > retries:
                        raise RuntimeError(f"request {batch} failed {attempt} times: {error}") from error
                    wait *= 2
                    time.sleep(wait)
            yield pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([attempt], pa.int32()), pa.array([xml], pa.string())], ["batch", "attempts", "xml"])
            time.sleep(pause)

    return batches.select(F.col("batch").cast("long").alias("batch"), "ids").repartition(lanes, "batch").sortWithinPartitions("batch").mapInArrow(run, RESPONSES)


def collected(requests: str, responses: str, batches: DataFrame, client: Callable[[Sequence[str]], str], *, wave: int = WAVE, **options) -> DataFrame:
    """The table `responses` with an answer to each request. The requests are written first, and a run that finds a table of requests goes on with the batches
    that have no answer yet, which must be of the same ids. Answers are committed in waves of `wave` requests; only numbers of batches pass the driver."""
    spark = batches.sparkSession
    if not storage.exists(f"{requests}/_SUCCESS"):
        batches.select(F.col("batch").cast("long").alias("batch"), "ids").write.mode("overwrite").parquet(requests)
    else:
        before, now = (x.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.col("batch").cast("long"), "ids").cast("decimal(38,0)")).alias("ids")).first() for x in (spark.read.parquet(requests), batches))
        if before != now:
            raise ValueError("what was asked before is not what is asked now")
    asked = spark.read.parquet(requests)
    if not storage.exists(responses):
        spark.createDataFrame([], RESPONSES).write.parquet(responses)
    last = asked.agg(F.max("batch")).first()[0]
    for first in range(0, (-1 if last is None else last) + 1, wave):
        own = asked.where(F.col("batch").between(first, first + wave - 1)).join(spark.read.schema(RESPONSES).parquet(responses).select("batch"), "batch", "left_anti")
        if not own.isEmpty():
            fetched(own, client, **options).write.mode("append").parquet(responses)
    return spark.read.schema(RESPONSES).parquet(responses)

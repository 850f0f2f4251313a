"""Counters of a running stream as health rows, without a job of their own.

    counted = health.translations(asked)             # Dataset.observe
    spark.streams.addListener(health.Reports("s3://bucket/health"))

Spark sums observed metrics while a batch runs; a listener on the driver writes
them when the batch is done, one small file for a batch, under a name that a
batch which runs again uses again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from lectern.sources import pcm

REPORT = "query string, batch long, at string, name string, key string, value double"


def translations(asked: DataFrame, name: str = "translation") -> DataFrame:
    """asked (text, hit, failed), observed: hits of the cache, calls that came back and their characters, errors."""
    call = ~F.col("hit") & ~F.col("failed")
    return asked.observe(
        name,
        F.count_if("hit").alias("hits"),
        F.count_if(call).alias("calls"),
        F.coalesce(F.sum(F.when(call, F.char_length("text"))), F.lit(0)).alias("chars"),
        F.count_if(~F.col("hit") & F.col("failed")).alias("errors"),
    )


class Reports(StreamingQueryListener):
    """Writes what each batch of any query has observed, and its rows and time."""

    def __init__(self, path: str):
        self.path = path

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = {(name, key): value for name, row in p.observedMetrics.items() for key, value in row.asDict().items()}
        found |= {("query", "rows"): p.numInputRows, ("query", "ms"): p.batchDuration}
        lines = [json.dumps({"query": str(p.id), "batch": p.batchId, "at": p.timestamp, "name": n, "key": k, "value": float(v)}) for (n, k), v in found.items() if v is not None]
        system, root = pcm.located(self.path)
        system.create_dir(root)
        with system.open_output_stream(f"{root}/{p.id}-{p.batchId}.json") as out:
            out.write("\n".join(lines).encode())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(query, name, key, total, last): over all batches."""
    rows = spark.read.schema(REPORT).json(path)
    return rows.groupBy("query", "name", "key").agg(F.sum("value").alias("total"), F.max_by("value", "batch").alias("last"))

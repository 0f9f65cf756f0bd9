"""Streaming ingest, an extra: documents that arrive in a folder go through the batch transforms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_documents(spark: SparkSession, path: str, schema: str, sink: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Each micro-batch of new parquet files is given to sink (batch frame, batch id), which must be idempotent in the id."""
    stream = spark.readStream.schema(schema).parquet(path)
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def call_rates(calls: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Calls and tokens per stage and time window of a streaming call log; later rows than `late` are let go."""
    return calls.withWatermark("started_at", late).groupBy(F.window("started_at", window), "stage").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"))

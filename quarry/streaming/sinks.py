"""Sinks of streams whose batches may come again, and findings that are given once for good."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_seen(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Findings of a stream, each once: the first row of each value of keys (type and data if not given). What was seen is keyed state of the query, kept
    with its checkpoint over restarts, in the state store: it grows with the different findings, not with the texts."""
    return findings.dropDuplicates(keys or ["type", "data"])


def write_batches(stream: DataFrame, folder: str, checkpoint: str, change: Callable[[DataFrame, int], DataFrame] | None = None, **trigger) -> StreamingQuery:
    """Start a query that writes each batch as Parquet to folder/batch=<number>. A batch that comes again after a failure replaces what it left, whole or in part, so a row is
    there once. change(batch, number) is applied to each batch; trigger: as for DataStreamWriter.trigger."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if change is None else change(batch, number)
        rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()


def read_batches(spark: SparkSession, folder: str) -> DataFrame:
    """What write_batches wrote, with the number of its batch as a column; batches that are being written are not seen."""
    return spark.read.option("basePath", folder).parquet(f"{folder.rstrip('/')}/batch=*").withColumn("batch", F.col("batch").cast("long"))

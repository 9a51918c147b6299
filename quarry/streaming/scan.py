"""Extraction over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quarry.operators.extract import extract_secrets
from quarry.rules import Rule


def stream_secrets(stream: DataFrame, text: str, rules: list[Rule], time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Findings of a stream of texts. With a time column, a finding that repeats within `late` is given once: state is kept no longer than that."""
    found = extract_secrets(stream, text, rules)
    if time is None:
        return found
    return found.withWatermark(time, late).dropDuplicatesWithinWatermark([c for c in found.columns if c != time])


def watch_parquet(spark: SparkSession, folder: str, schema: T.StructType, files_at_once: int = 100) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)

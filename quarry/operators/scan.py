"""Scan of files: the rules over each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.operators.extract import extract_secrets
from quarry.rules import Rule
from quarry.sources.files import read_files


def local_scan(spark: SparkSession, path: str, rules: list[Rule], engine: str = "groups") -> DataFrame:
    """(path, type, data) of a file, or of all files below a folder, of any filesystem that Spark reads; files without secrets give no rows."""
    return extract_secrets(read_files(spark, path), "text", rules, engine)

"""A corpus pipeline of five stages: quality rules, near duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last
return the columns of documents; n_chars follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import jaccard, packing, pii, quality, substrings
from quarry.session import cut, drop


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast("long"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go: those that repeat their words or lines, and those of symbols, digits or no real words. No least length holds
    here, as short documents may be clean; null texts and texts without words go; equal texts fare alike; an empty table stays one."""
    return quality.filter_documents(docs, quality.ANY_LENGTH)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, five-word shingles at a Jaccard similarity of 0.8, the smallest doc_id stays; a null one is the smallest. Rows that repeat
    doc_id and text are one; different texts of one doc_id are judged each by itself; texts without words, or null, link with nothing and stay."""
    return jaccard.keep_first(docs, jaccard.Join(words=5, percent=80))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a document of a smaller doc_id has are taken out; documents of which nothing is left go. Null texts and texts that
    were empty before stay as they are; rows of one doc_id do not count against each other."""
    done = substrings.remove_repeats(docs.withColumn("_was_empty", F.col("text") == ""))
    return _counted(done).filter("text is null or text != '' or _was_empty").drop("_was_empty")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, and terms that reveal it are generalised or removed. All rows stay, null texts as they are; equal texts
    become equal texts."""
    return _counted(pii.sanitize(docs))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where the pieces of each document stand in sequences of 4096 tokens. A null or empty text is one piece of the end id; equal rows have places of their own;
    an empty table gives no rows."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed_sequences", packed_sequences),
]
#: Tokenizers, greedy packing and components are not for SQL; tests/llm holds the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, name)
            # A stage's table is done with when the next one is written.
            drop(*before)
            before = [docs]
    return docs

"""A bitmap of keys of fixed size, as a broadcast table: drops most rows without a partner before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map, whatever the number of keys: KEY_BITS / 64 rows of 12 bytes at most are broadcast.
KEY_BITS = 1 << 22


def only_possible(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """The rows whose column's bit is set by a key: all that have a partner among keys, and few others while keys are fewer than bits.

    With far more keys than bits everything passes, and the join behind it does all the work.
    """
    return split_possible(rows, column, keys, key)[0]


def split_possible(rows: DataFrame, column: str, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """only_possible, and the rows that it leaves out: those have no partner, and need not be moved to find that out."""
    bit = F.pmod(F.xxhash64(key), F.lit(KEY_BITS))
    marked = keys.select((bit / 64).cast("int").alias("_word"), bit.alias("_bit"))
    marked = marked.select("_word", F.expr("shiftleft(1L, cast(_bit % 64 as int))").alias("_one"))
    words = F.broadcast(marked.groupBy("_word").agg(F.bit_or("_one").alias("_bits")))
    own = rows.withColumn("_own_bit", F.pmod(F.xxhash64(column), F.lit(KEY_BITS)))
    hit = (F.expr("cast(_own_bit / 64 as int)") == F.col("_word")) & (F.expr("_bits & shiftleft(1L, cast(_own_bit % 64 as int))") != 0)
    return own.join(words, hit, "left_semi").drop("_own_bit"), own.join(words, hit, "left_anti").drop("_own_bit")

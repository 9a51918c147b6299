"""Gapless ranks inside groups of any size, without one task for a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets of a group: each is ranked by itself, and begins after the rows of those before it.
BUCKETS = 4096


def gapless_rank(df: DataFrame, group: str, order: list[str], name: str, counted: DataFrame | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Add name: 0, 1, 2 ... in each group, in a fixed order that hash buckets of the order columns give.

    A group is split over `buckets` hash buckets, so that a hot group becomes many small sorts. The table of
    bucket counts has at most groups * buckets rows; it is joined by its keys. counted: a cheaper frame
    with the same rows of group and order, to count. Equal rows get neighbouring ranks; which of them comes first does not
    matter as they are equal.
    """
    bucket: Column = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    counts = (counted if counted is not None else df).groupBy(F.col(group).alias("_g"), bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_g", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    ranked = df.withColumn("_bucket", bucket).withColumn("_row", F.row_number().over(inside).cast("long") - 1)
    joined = ranked.join(starts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_bucket") == F.col("_b")), "left")
    return joined.withColumn(name, F.col("_before") + F.col("_row")).drop("_g", "_b", "_before", "_bucket", "_row")

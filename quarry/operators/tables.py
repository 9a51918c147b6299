"""Filters whose patterns or ranges are tables: semi-joins on keys, with the pattern or range itself checked behind them.

Each different value is looked up once, then the rows are joined to the values that match: so a value of very many rows costs one lookup. No step compares all values with
all patterns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.errors import ConfigError
from quarry.functions.patterns import glob_to_regex
from quarry.session import cut, ship_package

#: Characters, at least and at most, of the pieces that globs without a fixed end are found by, and globs without such a piece (as `*` or `a?*`) at most, which become one condition.
PIECE, WIDE, BARE = 3, 8, 1000
_SPECIAL = re.compile(r"\[[!]?\]?[^\]]*\]|[*?]")


def glob_keys(glob: str) -> list[str]:
    """Each of these stands for something that all hosts have which a glob matches: `=` and the host itself, `.` and its last whole labels, or `+` and pieces of it; none if nothing is known."""
    fixed = _SPECIAL.split(glob)
    if len(fixed) == 1:
        return ["=" + glob]
    _, dot, labels = fixed[-1].partition(".")
    if dot and labels:
        return ["." + labels]
    longest = max(fixed, key=len)
    size = min(len(longest), WIDE)
    return sorted({"+" + longest[i : i + size] for i in range(len(longest) - size + 1)}) if size >= PIECE else []


def glob_index(globs: DataFrame) -> DataFrame:
    """(key, regex, size) of globs(glob), of several keys the one that fewest globs have; size: labels of a key of labels, characters of a piece. Null globs are left out."""
    ship_package(globs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([glob_to_regex(g) for g in own], pa.string()), pa.array([glob_keys(g) or [""] for g in own], pa.list_(pa.string()))], ["regex", "keys"])

    each = cut(globs.select("glob").filter("glob is not null").distinct().mapInArrow(run, "regex string, keys array<string>").select("regex", F.explode("keys").alias("key")), "globs")
    shared = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(shared, "key").groupBy("regex").agg(F.min(F.struct("n", "key")).alias("best")).select("best.key", "regex")
    size = F.when(F.startswith("key", F.lit(".")), F.size(F.split("key", r"\.")) - 1).otherwise(F.length("key") - 1)
    return rarest.withColumn("size", size)


def matching_hosts(hosts: DataFrame, globs: DataFrame) -> DataFrame:
    """The different hosts of hosts(host) that any glob of globs(glob) matches; case counts, as for domain_allowed."""
    index = cut(glob_index(globs), "globs")
    kinds = {r["kind"]: r for r in index.groupBy(F.substring("key", 1, 1).alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("most"), F.collect_set(F.least("size", F.lit(WIDE))).alias("sizes")).collect()}
    once = hosts.select("host").filter("host is not null").distinct()
    labels = F.split("host", r"\.", -1)
    keys = []
    if "=" in kinds:
        keys.append(F.array(F.concat(F.lit("="), F.col("host"))))
    if "." in kinds:
        depths = F.sequence(F.lit(1), F.least(F.size(labels) - 1, F.lit(kinds["."]["most"])))
        ends = F.transform(depths, lambda d: F.concat(F.lit("."), F.array_join(F.slice(labels, -d, d), ".")))
        keys.append(F.when(F.size(labels) > 1, ends).otherwise(F.array().cast("array<string>")))
    for size in kinds["+"]["sizes"] if "+" in kinds else []:
        places = F.sequence(F.lit(1), F.length("host") - (size - 1))
        pieces = F.array_distinct(F.transform(places, lambda i: F.concat(F.lit("+"), F.substring(F.col("host"), i, F.lit(size)))))  # noqa: B023
        keys.append(F.when(F.length("host") >= size, pieces).otherwise(F.array().cast("array<string>")))
    found = once.limit(0)
    if keys:
        asked = once.select("host", F.explode(F.concat(*keys)).alias("key"))
        found = asked.join(index.filter("key != ''"), "key").filter(F.expr("host rlike regex")).select("host")
    if "" in kinds:
        if kinds[""]["n"] > BARE:
            raise ConfigError(f"{kinds['']['n']} patterns without {PIECE} fixed characters in a row; {BARE} at most")
        bare = "|".join(r["regex"] for r in index.filter("key = ''").collect())
        found = found.union(once.filter(F.col("host").rlike(bare)))
    return found.distinct()


def by_globs(df: DataFrame, host: str, globs: DataFrame, deny: bool = False) -> DataFrame:
    """The rows whose host any of globs(glob) matches, or those that none does; a null host matches nothing."""
    hosts = matching_hosts(df.select(F.col(host).alias("host")), globs).select(F.col("host").alias("_host"))
    return df.join(hosts, F.col(host) == F.col("_host"), "left_anti" if deny else "left_semi")


def by_ranges(df: DataFrame, value: str, ranges: DataFrame, outside: bool = False) -> DataFrame:
    """The rows whose value, a whole number, lies in any of ranges(low, high), high excluded, or those of which it lies in none. Empty ranges and those with a null end hold
    nothing; a null value lies in none.

    A range has the cell size of the power of two from its length up, and so two cells at most, whatever its length; a value has one cell for each size in use, 64 at most.
    """
    whole = ranges.select(F.col("low").cast("long").alias("_low"), F.col("high").cast("long").alias("_high")).filter("_low < _high").distinct()
    # The length of a range beyond the longs counts as the greatest one.
    length = F.when(F.expr("_low < 0 and _high > _low + 9223372036854775807L"), F.lit(62)).otherwise(F.least(F.ceil(F.log2((F.col("_high") - F.col("_low")).cast("double"))), F.lit(62)))
    sized = cut(whole.withColumn("_size", length.cast("int")), "ranges")
    sizes = [r[0] for r in sized.select("_size").distinct().collect()]
    cells = sized.select("*", F.explode(F.sequence(F.expr("shiftright(_low, _size)"), F.expr("shiftright(_high - 1, _size)"))).alias("_cell"))
    values = df.select(F.col(value).cast("long").alias("_value")).filter("_value is not null").distinct()
    if not sizes:
        return df if outside else df.limit(0)
    asked = values.select("_value", F.explode(F.array(*(F.lit(s) for s in sizes))).alias("_size")).withColumn("_cell", F.expr("shiftright(_value, _size)"))
    found = asked.join(cells, ["_size", "_cell"]).filter("_low <= _value and _value < _high").select("_value").distinct()
    return df.join(found, F.col(value).cast("long") == F.col("_value"), "left_anti" if outside else "left_semi")

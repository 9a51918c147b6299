"""Answers that are used again while they are fresh."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.schemas import ANSWER, PAGE
from quarry.session import cut, drop


def _micros(when: str) -> Column:
    return F.unix_micros(F.col(when).cast("timestamp"))


def as_of(requests: DataFrame, answers: DataFrame, key: str, when: str, seconds: float) -> DataFrame:
    """requests with `answer`: of the answers to the same key that are no later, and less than so many seconds old, the latest; null if there is none.

    requests and answers have the columns key and when, a timestamp; the answer is a struct of all columns of answers but the key. Of answers of one time the greatest counts. Rows without
    key or time have no answer.

    Time is cut into cells of that many seconds, so an answer lies in the request's cell or in the one before. A cell of a key is ordered by itself, and of the cell before only the
    latest answer is needed; equal requests ask once. So a key that is asked for all the time is many small windows.
    """
    width = int(seconds * 1_000_000)
    cell = lambda t: F.floor(_micros(t) / F.lit(width)).cast("long")
    asked = requests.select(F.col(key).alias("_k"), F.col(when).alias("_t")).filter("_k is not null and _t is not null").distinct().withColumn("_c", cell("_t"))
    rest = [c for c in answers.columns if c not in (key, when)]
    given = answers.filter(F.col(key).isNotNull() & F.col(when).isNotNull()).select(F.col(key).alias("_k"), F.struct(F.col(when), *rest).alias("_a")).withColumn("_t", F.col(f"_a.{when}")).withColumn("_c", cell("_t"))
    before = given.groupBy("_k", (F.col("_c") + 1).alias("_c")).agg(F.max("_a").alias("_before"))
    both = given.select("_k", "_c", "_t", F.lit(0).alias("_ask"), "_a").unionAll(asked.select("_k", "_c", "_t", F.lit(1), F.lit(None)))
    order = Window.partitionBy("_k", "_c").orderBy("_t", "_ask", "_a").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_own", F.last("_a", ignorenulls=True).over(order)).filter("_ask = 1").select("_k", "_c", "_t", "_own")
    fresh = _micros("_t") - _micros(f"_before.{when}") < width
    found = own.join(before, ["_k", "_c"], "left").select("_k", "_t", F.coalesce("_own", F.when(fresh, F.col("_before"))).alias("answer")).filter("answer is not null")
    return requests.join(found, (F.col(key) == F.col("_k")) & (F.col(when) == F.col("_t")), "left").drop("_k", "_t")


class Answers:
    """The answers of a session's fetches, kept for so many seconds in the shared folder; requests that failed are not kept. clock: seconds since the epoch."""

    def __init__(self, spark: SparkSession, seconds: float = 60, clock: Callable[[], float] = time.time):
        self.spark, self.seconds, self.clock = spark, seconds, clock
        self._parts: list[tuple[float, DataFrame]] = []

    def table(self) -> DataFrame:
        """The answers at hand, a row for each."""
        kept = self.spark.createDataFrame([], ANSWER)
        for _, part in self._parts:
            kept = kept.unionAll(part)
        return kept

    def forget(self) -> None:
        """Delete the tables all of whose answers are too old. A DataFrame that an earlier fetch gave must have been read by then."""
        old = [p for p in self._parts if p[0] <= self.clock() - self.seconds]
        self._parts = [p for p in self._parts if p not in old]
        drop(*(part for _, part in old))

    def fetch(self, ask: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        """A fetch that takes fresh answers from the table, and asks, once and at the call, for all other urls. `ask` may tell when an answer came in a column `answered`; else it came now."""

        def fetch(urls: DataFrame) -> DataFrame:
            now = F.timestamp_micros(F.lit(int(self.clock() * 1_000_000)))
            wanted = urls.select("url").filter("url is not null").distinct().withColumn("answered", now)
            if not self._parts:
                got, kept = ask(wanted.select("url")), None
            else:
                looked = cut(as_of(wanted, self.table(), "url", "answered", self.seconds).select("url", "answer"), "looked")
                kept = looked.filter("answer is not null").select("url", *(F.col(f"answer.{c}").alias(c) for c in PAGE.names[1:]))
                got = ask(looked.filter("answer is null").select("url"))
            came = F.col("answered").cast("timestamp") if "answered" in got.columns else now
            fresh = cut(got.select(*PAGE.names, came.alias("answered")), "answers")
            answered = fresh.filter("status is not null")
            answered._quarry_path = fresh._quarry_path
            self._parts.append((self.clock(), answered))
            out = fresh.select(*PAGE.names)
            return out if kept is None else out.unionAll(kept)

        return fetch

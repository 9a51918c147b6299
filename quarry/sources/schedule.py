"""When requests start: lanes of a host over several tasks, which keep its limits without talking to each other.

A host that may have so many requests at a time has so many lanes. Its urls are ranked without a task for a host and dealt to the lanes in turn; a lane is one task's, which asks one
url after another. Time is cut into slots of one interval, the same ones everywhere as they are counted from the epoch; of a host's slots each lane owns every so many. So two starts
of a host are never in one slot, and there are never more requests than lanes, in whatever tasks and whenever the lanes run.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.urls import rate_domain

#: A lane that is later than this share of an interval lets its slot pass.
LATE = 0.2


def ranked_by_host(urls: DataFrame) -> DataFrame:
    """(url, domain, rank): distinct urls with their rank in their host, from 0, in the order of their MD5.

    A host is cut into 256 ranges of that order, each ranked by itself behind the sizes of those before it, so no host is one task.
    """
    own = urls.select("url").filter("url is not null").distinct().select("url", rate_domain(F.col("url")).alias("domain"), F.md5("url").alias("_h")).withColumn("_b", F.substring("_h", 1, 2))
    before = Window.partitionBy("domain").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = own.groupBy("domain", "_b").agg(F.count(F.lit(1)).alias("_n")).select(F.col("domain").alias("_d"), F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = own.withColumn("_row", F.row_number().over(Window.partitionBy("domain", "_b").orderBy("_h", "url")) - 1)
    joined = inside.join(sizes, (F.col("domain") == F.col("_d")) & (F.col("_b") == F.col("_c")))
    return joined.select("url", "domain", (F.col("_before") + F.col("_row")).alias("rank"))


def start_schedule(urls: DataFrame, per_domain: int, interval: float) -> DataFrame:
    """(url, domain, lane, turn, start): distinct urls with their host, the host's lane that asks for them, their turn in the lane, and the earliest start in
    seconds from the beginning of the host. Null urls are left out."""
    return ranked_by_host(urls).select("url", "domain", (F.col("rank") % per_domain).cast("int").alias("lane"), F.floor(F.col("rank") / per_domain).cast("long").alias("turn"), (F.col("rank") * F.lit(float(interval))).alias("start"))


def dealt(urls: DataFrame, per_domain: int, tasks: int) -> DataFrame:
    """(url, domain, lane) dealt to so many tasks: a lane is in one of them, by turn."""
    planned = start_schedule(urls, per_domain, 0)
    # A named number of partitions, as a few urls are little to read but long to ask for.
    return planned.repartition(tasks, "domain", "lane").sortWithinPartitions("turn", "domain", "lane").select("url", "domain", "lane")


class LaneClock:
    """The slots of one lane. now and sleep: the clock, in seconds since the epoch."""

    def __init__(self, lane: int, lanes: int, interval: float, now: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.lane, self.lanes, self.interval, self.now, self.sleep = lane, lanes, interval, now, sleep

    def wait(self) -> float:
        """Wait for the lane's next slot; its beginning. Without an interval there is nothing to wait for."""
        if not self.interval:
            return self.now()
        while True:
            slot = math.floor(self.now() / self.interval) + 1
            slot += (self.lane - slot) % self.lanes
            start = slot * self.interval
            while (left := start - self.now()) > 0:
                self.sleep(left)
            if self.now() - start <= LATE * self.interval:
                return start

"""How filters interact: what each step removes in every order of the filters, and Shapley values.

Documents become cells: how many of a part fail just these filters (a mask of bits), with how many of them good or toxic. All orders are then visited by
adjacent transpositions (plain changes): each order differs from the one before by one swap of neighbours, so that only two steps are worked out anew from
the cells, and a filter's share of all orders accumulates whenever its step changes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import cut, ship_package

SPACES = r"[\x20\x09-\x0D]+"
WEIGHTS = ["n", "good", "toxic"]
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
#: Parts walked through at a time: 600 rows each at five filters.
PARTS = 256


def text_filters(text: str = "text") -> dict[str, Column]:
    """Failure conditions on a text that is not null, by letter: few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.length(text),
        "D": F.col(text).rlike("[#$%&*|]"),
    }


def plain_changes(n: int) -> Iterator[int]:
    """Places j whose swap with j + 1 leads from one order of n things to the next, through all n! of them (Steinhaus, Johnson, Trotter)."""
    order, way = list(range(n)), [-1] * n
    while True:
        for thing in reversed(range(n)):
            at = order.index(thing)
            to = at + way[thing]
            if 0 <= to < n and order[to] < thing:
                break
        else:
            return
        order[at], order[to] = order[to], order[at]
        way[thing + 1 :] = [-w for w in way[thing + 1 :]]
        yield min(at, to)


class Walk:
    """Steps of one order after another, from cells of shape (parts, 2**filters, 3): documents, good ones, toxic ones by mask."""

    def __init__(self, cells: np.ndarray, letters: str):
        self.cells, self.letters, self.n = cells, letters, len(letters)
        self.masks = np.arange(1 << self.n)
        self.order = list(range(self.n))
        self.steps = [np.empty(0, np.int64)] * self.n
        #: Of each filter: what it removed in all orders so far but those since its step last changed, and the number of orders before that change.
        self.shapley = np.zeros((len(cells), self.n), np.int64)
        self.since = [0] * self.n
        self.orders = 0
        for place in range(self.n):
            self._work_out(place)

    def _work_out(self, place: int) -> None:
        """kept, removed, redundant, unique_fails, good_lost, toxic_lost of the step at a place."""
        before = sum(1 << f for f in self.order[:place])
        own = 1 << self.order[place]
        reached, fails = (self.masks & before) == 0, (self.masks & own) != 0
        n = self.cells[:, :, 0]
        gone = self.cells[:, reached & fails].sum(axis=1)
        self.steps[place] = np.stack(
            [n[:, reached & ~fails].sum(axis=1), gone[:, 0], n[:, ~reached & fails].sum(axis=1), n[:, own], gone[:, 1], gone[:, 2]], axis=1
        )

    def _settle(self, place: int) -> None:
        f = self.order[place]
        self.shapley[:, f] += self.steps[place][:, 1] * (self.orders - self.since[f])
        self.since[f] = self.orders

    def run(self) -> tuple[list[str], np.ndarray]:
        """All orders as strings, and counts of shape (orders, steps, parts, 7)."""
        names, out = [self._name()], [list(self.steps)]
        self.orders = 1
        for j in plain_changes(self.n):
            self._settle(j)
            self._settle(j + 1)
            self.order[j], self.order[j + 1] = self.order[j + 1], self.order[j]
            self._work_out(j)
            self._work_out(j + 1)
            self.orders += 1
            names.append(self._name())
            out.append(list(self.steps))
        for place in range(self.n):
            self._settle(place)
        counts = np.stack([np.stack(steps) for steps in out])
        own = np.array([[self.letters.index(x) for x in name] for name in names])
        return names, np.concatenate([counts, self.shapley.T[own][..., None]], axis=3)

    def _name(self) -> str:
        return "".join(self.letters[f] for f in self.order)


def mask_cells(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> tuple[DataFrame, str]:
    """(part, mask, n, good, toxic) of all parts and masks that occur, and the filters' letters in the order of the mask's bits; the last, E, is failed by texts that a row of a smaller key has.

    Texts are told apart by their length and SHA-256. A hot text, part or key meets map-side sums and joins between exchanges only, which Spark can split. The rows
    that do not fail E are those that stand at their text's least key; they are summed by themselves, so no group of copies is brought together.
    """
    filters = text_filters("_t")
    letters = "".join(filters) + "E"
    mask = sum((F.when(x, F.lit(1 << i)).otherwise(F.lit(0)) for i, x in enumerate(filters.values())), F.lit(0))
    own = df.select(df[key].alias("_k"), F.coalesce(df[part].cast("string"), F.lit("")).alias("_p"), F.coalesce(df[text], F.lit("")).alias("_t"))
    rows = own.select("_k", "_p", mask.alias("_m"), F.length("_t").alias("_l"), F.unhex(F.sha2("_t", 256)).alias("_h"))
    marks = labels.filter("doc_id is not null and (quality = 1 or toxic = 1)").groupBy(labels["doc_id"].alias("_d"))
    marks = marks.agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    marked = cut(rows.join(cut(marks, "labels"), F.col("_k") == F.col("_d"), "left").drop("_d"), "masks")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")]
    first = cut(marked.filter("_k is not null").groupBy("_l", "_h").agg(F.min("_k").alias("_k")), "firsts")
    # A null key is neither smaller nor larger than another.
    passing = marked.join(first, ["_l", "_h", "_k"], "left_semi").select("_p", "_m", "good", "toxic").unionAll(marked.filter("_k is null").select("_p", "_m", "good", "toxic"))
    passing = passing.groupBy("_p", "_m").agg(*sums)
    failing = marked.groupBy("_p", "_m").agg(*sums).unionAll(passing.select("_p", "_m", *(-F.col(w) for w in WEIGHTS)).toDF("_p", "_m", *WEIGHTS))
    e = 1 << len(filters)
    both = passing.unionAll(failing.select("_p", F.col("_m") + e, *WEIGHTS))
    cells = both.groupBy(F.col("_p").alias("part"), F.col("_m").alias("mask")).agg(*(F.sum(w).alias(w) for w in WEIGHTS))
    return cells, letters


def audit(cells: DataFrame, letters: str) -> DataFrame:
    """part, filter_order, step and the seven counts: a row for each part, order of all filters and step; cells: (part, mask, n, good, toxic)."""
    ship_package(cells.sparkSession)
    n = len(letters)
    wide = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *WEIGHTS)).alias("cells"))  # 2**n of a part at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                rows = batch.slice(at, PARTS).to_pylist()
                table = np.zeros((len(rows), 1 << n, len(WEIGHTS)), np.int64)
                for i, row in enumerate(rows):
                    for cell in row["cells"]:
                        table[i, cell["mask"]] += [cell[w] for w in WEIGHTS]
                names, counts = Walk(table, letters).run()
                for i, row in enumerate(rows):
                    flat = counts[:, :, i].reshape(-1, len(COUNTS))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["part"]] * len(flat), pa.string()),
                            pa.array(np.repeat(names, n).tolist(), pa.string()),
                            pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(names))),
                            *(pa.array(np.ascontiguousarray(flat[:, c])) for c in range(len(COUNTS))),
                        ],
                        ["part", "filter_order", "step", *COUNTS],
                    )

    return wide.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{c} long' for c in COUNTS)}")


def audit_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """Per part, order of the filters A to E and step: the seven counts, zeros included.

    A null text is empty (it fails A alone, and E beside other such texts), a null part is the empty string; rows of a null key have no labels, do not fail E and
    make none fail it; rows of one key and text fare alike, each counted; several labels of a key count together; an empty table gives no rows;
    other columns are left out.
    """
    cells, letters = mask_cells(df, labels, key, text, part)
    return audit(cells, letters)

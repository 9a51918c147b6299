"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersections.

Documents are sets of word shingles. Equal sets are one class, whose representative is its smallest document. Two sets can reach the
threshold only if they share one of the first few shingles of a common order (frequent shingles last), so a tile is a shingle and a band of
sizes. In a tile, signatures are compared first: their different bits bound the overlap from above; what is left is intersected exactly.

Classes are linked in two passes. The first compares every class with one leader of its tile, and joins what is linked; the second compares
only classes of one shingle that the first left in different components. So copies are not compared all with all, and no link between
components is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.components import connected_components
from quarry.llm.prefilter import only_possible
from quarry.llm.words import BYTE_VALUES, LOWER_VALUES, U64, Batch, shingle_hashes, slices
from quarry.session import cut, drop, ship_package

#: Shingles that are put last in the common order, at most; which they are decides the work, not the result.
FREQUENT = 1 << 18
#: Classes of a shingle in a tile, about; larger groups are split into blocks that meet pairwise.
TILE = 512
NULL_ID = -(2**63)


@dataclass(frozen=True)
class Join:
    """words: words of a shingle; percent: links need 100 * intersection >= percent * union; lower: fold A-Z."""

    words: int = 5
    percent: int = 80
    lower: bool = True

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """How many first shingles of a set of n must be looked at."""
        return n - (self.percent * n + 99) // 100 + 1

    def need(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least overlap with which sets of a and b link."""
        return -((-self.percent * (a + b)) // (100 + self.percent))


def shingle_sets(texts: list[bytes], join: Join) -> tuple[np.ndarray, np.ndarray]:
    """All shingles, sorted within each text, and where each text's begin. A text of fewer words has one, all its words."""
    b = Batch(texts)
    words = b.hashes(LOWER_VALUES if join.lower else BYTE_VALUES)
    first, doc = b.windows(join.words)
    grams = shingle_hashes(words, first, join.words)
    for k in range(1, join.words):
        short = np.flatnonzero(b.n_words == k)
        if len(short):
            grams = np.concatenate([grams, shingle_hashes(words, b.word_from[short], k)])
            doc = np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[fresh], doc[fresh]
    return grams, np.searchsorted(doc, np.arange(b.n + 1))


def signature(grams: np.ndarray) -> bytes:
    """A bitmap of parities, of a power of 2 of at least as many bits as the set has shingles, 256 at least."""
    bits = 256
    while bits < len(grams):
        bits *= 2
    return np.packbits((np.bincount((grams & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """The signature that a smaller bitmap would have."""
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def may_link(sig: np.ndarray, sigs: np.ndarray, n: int, ns: np.ndarray, join: Join) -> np.ndarray:
    """Which of the sets with signatures sigs (one a row, as wide as sig) can link with a set: different bits are different shingles."""
    differ = _ONES[sigs ^ sig].sum(axis=1, dtype=np.int64)
    return (n + ns - differ) // 2 >= join.need(n, ns)


def _ids(df: DataFrame, key: str) -> Column:
    return F.coalesce(df[key].cast("long"), F.lit(NULL_ID))


def frequent_shingles(df: DataFrame, join: Join) -> np.ndarray:
    """Shingles that stand in many documents, sorted: those of 3 or more in a slice of texts, counted over all slices, the FREQUENT most
    frequent of 64 or more. All documents are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches, limit=1 << 22):
            grams, counts = np.unique(shingle_sets(texts, join)[0], return_counts=True)
            often = counts >= 3
            yield pa.RecordBatch.from_arrays([pa.array(grams[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], ["token", "n"])

    counted = df.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter("n >= 64")
    top = counted.orderBy(F.desc("n"), "token").limit(FREQUENT).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().astype(np.int64).view(np.uint64))


def describe(df: DataFrame, join: Join, frequent: np.ndarray) -> DataFrame:
    """Per row: id, n (size of its set), set (128 bits that name it), prefix (first shingles in the common order), sig."""
    last = df.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare_last = last.value
        for batch, texts in slices(batches):
            grams, begin = shingle_sets(texts, join)
            at = np.searchsorted(rare_last, grams)
            common = np.zeros(len(grams), bool)
            inside = at < len(rare_last)
            common[inside] = rare_last[at[inside]] == grams[inside]
            names, prefixes, sigs = [], [], []
            sizes = np.diff(begin)
            lengths = join.prefix(sizes)
            for i in range(len(texts)):
                own, often = grams[begin[i] : begin[i + 1]], common[begin[i] : begin[i + 1]]
                names.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                ordered = np.concatenate([own[~often], own[often]]) if often.any() else own
                prefixes.append(ordered[: lengths[i]].view(np.int64) if len(own) else np.empty(0, np.int64))
                sigs.append(signature(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(names, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(sigs, pa.binary())],
                ["id", "n", "set", "prefix", "sig"],
            )

    return df.mapInArrow(run, "id long, n long, set binary, prefix array<long>, sig binary")


def _sizes_fit(a: str, b: str, join: Join) -> Column:
    return F.least(F.col(a), F.col(b)) * 100 >= F.greatest(F.col(a), F.col(b)) * join.percent


def _place_fits(join: Join) -> Column:
    """The overlap that is still possible if the shared shingle is the first: sets na, nb, places pa, pb."""
    need = F.ceil((F.col("na") + F.col("nb")) * join.percent / (100 + join.percent) - F.lit(1e-6))
    return F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= need


def check_pairs(df: DataFrame, classes: DataFrame, pairs: DataFrame, join: Join) -> DataFrame:
    """The pairs (a, b) of representatives that link: signatures first, then exact intersections of sorted arrays."""

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for na, nb, sa, sb in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                x, y = np.frombuffer(sa, np.uint8), np.frombuffer(sb, np.uint8)
                size = min(len(x), len(y))
                keep.append(bool(may_link(fold(x, size), fold(y, size)[None, :], na, np.array([nb]), join)[0]))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: classes.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("sig").alias(f"s{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb")
    likely = cut(both.mapInArrow(bounded, "a long, b long").distinct(), "likely")
    wanted = likely.select(F.col("a").alias("id")).union(likely.select(F.col("b").alias("id"))).distinct()

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            grams, begin = shingle_sets(texts, join)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([grams[begin[i] : begin[i + 1]].tobytes() for i in range(len(texts))], pa.binary())], ["id", "grams"])

    wanted = cut(wanted, "wanted")
    near = only_possible(df, "id", wanted, "id")
    sets = cut(near.join(wanted, "id").select("id", "text").mapInArrow(arrays, "id long, grams binary").distinct(), "sets")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for ga, gb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(ga, np.uint64), np.frombuffer(gb, np.uint64)
                at = np.searchsorted(y, x)
                overlap = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * overlap >= join.percent * (len(x) + len(y) - overlap))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    held = lambda c: sets.select(F.col("id").alias(c), F.col("grams").alias(f"g{c}"))
    links = cut(likely.join(held("a"), "a").join(held("b"), "b").select("a", "b", "ga", "gb").mapInArrow(exact, "a long, b long").distinct(), "links")
    drop(likely, wanted, sets)
    return links


def _small_tiles(rows: DataFrame, join: Join) -> DataFrame:
    """Pairs of classes of one shingle but different components that sizes and places allow, for shingles of one tile. rows: token, rep, n, pos, component."""

    def pairs(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, rep, n, pos, component = columns
        def distinct() -> pa.RecordBatch:
            both = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
            return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        found, size, left, shift = [], 0, np.arange(len(token)), 1
        while True:
            left = left[left + shift < len(token)]
            left = left[token[left] == token[left + shift]]
            if not len(left):
                break
            i, j = left, left + shift
            ok = (component[i] != component[j]) & (rep[i] != rep[j]) & (100 * np.minimum(n[i], n[j]) >= join.percent * np.maximum(n[i], n[j]))
            ok &= np.minimum(n[i] - pos[i], n[j] - pos[j]) >= join.need(n[i], n[j])
            found.append(np.stack([rep[i[ok]], rep[j[ok]]]))
            size += int(ok.sum())
            shift += 1
            if size > 200_000:
                yield distinct()
                found, size = [], 0
        if found:
            yield distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 5
        for batch in batches:
            columns = [np.concatenate([h, batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64)]) for i, h in enumerate(held)]
            if not len(columns[0]):
                continue
            last = int(np.searchsorted(columns[0], columns[0][-1]))
            yield from pairs([c[:last] for c in columns])
            held = [c[last:] for c in columns]
        yield from pairs(held)

    dealt = rows.select("token", "rep", F.col("n").cast("long"), F.col("pos").cast("long"), "component").repartition("token").sortWithinPartitions("token")
    return dealt.mapInArrow(run, "a long, b long")


def _large_tiles(rows: DataFrame, join: Join) -> DataFrame:
    """The same for shingles of more classes than a tile takes: blocks of a band meet blocks of it and of the next, and signatures are compared in the tile.
    rows: token, rep, n, pos, band, component, sig, blocks."""
    schema = "a long, b long"
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    #: A row meets the blocks of its own band and of the next: first role as the smaller, second as the larger.
    own = rows.withColumn("block", block)
    smaller = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other"), F.lit(0).alias("role"))
    larger = own.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("other"), F.lit(1).alias("role"))
    upper = larger.withColumn("band", F.col("band") - 1)
    tile = lambda d, x, y: d.select("token", "band", F.col(x).alias("x"), F.col(y).alias("y"), "role", "rep", "n", "pos", "component", "sig")
    dealt = tile(smaller, "block", "other").union(tile(larger, "other", "block")).union(tile(upper.withColumn("role", F.lit(2)), "other", "block"))
    dealt = dealt.repartition("token", "band", "x", "y").sortWithinPartitions("token", "band", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(tile: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            role, rep, n, pos, component = (tile.column(i).to_numpy(zero_copy_only=False) for i in range(4, 9))
            first, second = np.flatnonzero(role == 0), np.flatnonzero(role > 0)
            if not len(first) or not len(second):
                return np.empty(0, np.int64), np.empty(0, np.int64)
            raw = tile.column(9).to_pylist()
            width = min(map(len, raw))
            sigs = np.stack([fold(np.frombuffer(s, np.uint8), width) for s in raw])
            left, right = [], []
            for i in first:
                j = second[(component[second] != component[i]) & (100 * np.minimum(n[second], n[i]) >= join.percent * np.maximum(n[second], n[i]))]
                j = j[(role[j] == 2) | (rep[j] > rep[i])]
                j = j[np.minimum(n[i] - pos[i], n[j] - pos[j]) >= join.need(n[i], n[j])]
                if len(j):
                    j = j[may_link(sigs[i], sigs[j], int(n[i]), n[j], join)]
                    left.append(np.full(len(j), rep[i]))
                    right.append(rep[j])
            return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64), np.empty(0, np.int64))

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            whole = table.combine_chunks().to_batches()[0]
            keys = np.stack([whole.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            edges = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True])
            found = [pairs(whole.slice(b, e - b)) for b, e in zip(edges[:-1], edges[1:], strict=True) if e - b > 1]
            a = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
            b = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
            if len(a):
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            last = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield from emit(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif held and any(held[-1].column(i)[-1] != batch.column(i)[0] for i in range(4)):
                yield from emit(pa.Table.from_batches(held))
                held = []
            held.append(batch.slice(last))
        if held:
            yield from emit(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def _classes(rows: DataFrame, join: Join) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (id, text): members (id, n, rep) of all rows, classes (rep, n, prefix, sig) of different sets, and tiles (token, rep, n, pos, band) of the
    prefix shingles that several classes have. All are written; aggregates before they are joined, so that Spark can split hot keys."""
    described = cut(describe(rows, join, frequent_shingles(rows, join)), "described")
    named = cut(described.filter("n > 0").groupBy("set").agg(F.min("id").alias("rep")), "named")
    members = cut(described.select("id", "n", "set").join(named, "set", "left").select("id", "n", F.coalesce("rep", "id").alias("rep")), "members")
    own = (F.col("set") == F.col("_set")) & (F.col("id") == F.col("rep"))
    classes = cut(described.join(named.withColumnRenamed("set", "_set"), own).select("rep", "n", "prefix", "sig").dropDuplicates(["rep", "sig"]), "classes")
    drop(described, named)
    tokens = classes.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))
    shared = cut(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("token"), "shared")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / join.percent)) + F.lit(1e-9)).cast("int")
    tiles = cut(tokens.join(shared, "token").withColumn("band", band), "tiles")
    drop(shared)
    slim = cut(classes.select("rep", "n", "sig"), "slim")
    drop(classes)
    return members, slim, tiles


def _crossing(placed: DataFrame, classes: DataFrame, join: Join) -> DataFrame:
    """Candidate pairs (a, b) of classes that share a prefix shingle and have different components. placed: token, rep, n, pos, band, component."""
    mixed = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("c")).filter("low != high")
    mixed = cut(mixed.select("token", F.ceil(F.col("c") / TILE).alias("blocks")), "mixed")
    apart = cut(placed.join(mixed, "token"), "apart")
    large = apart.filter("blocks > 1").join(classes.select("rep", "sig"), "rep")
    crossing = cut(_small_tiles(apart.filter("blocks = 1"), join).union(_large_tiles(large, join)).distinct(), "crossing")
    drop(mixed, apart)
    return crossing


def _back(column: str) -> Column:
    return F.when(F.col(column) != NULL_ID, F.col(column))


def join_documents(df: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_shingles, component_id: the smallest key that links reach, its own included.

    A text without words, or null, has no shingles and links with nothing, equal texts included. Keys name documents; where a key
    repeats with another text, each row has its own links. A null key counts as smaller than all others and is null again in the result; equal rows give equal
    rows; an empty table gives none; other columns are left out. Work tables, of shingle hashes and ids, go to the shared folder.
    """
    ship_package(df.sparkSession)
    rows = df.select(_ids(df, key).alias("id"), df[text].alias("text"))
    members, classes, tiles = _classes(rows, join)
    leaders = cut(tiles.groupBy("token", "band").agg(F.min(F.struct("rep", "n", "pos")).alias("first")), "leaders")
    led = tiles.join(leaders, ["token", "band"]).select(
        F.col("first.rep").alias("a"), F.col("first.n").alias("na"), F.col("first.pos").alias("pa"), F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb")
    )
    stars = cut(led.filter("a != b").filter(_sizes_fit("na", "nb", join)).filter(_place_fits(join)).select("a", "b").distinct(), "stars")
    drop(leaders)
    links = check_pairs(rows, classes, stars, join)
    drop(stars)
    parts = connected_components(links)

    placed = tiles.join(parts, F.col("rep") == F.col("node"), "left").select("token", "rep", "n", "pos", "band", F.coalesce("component", "rep").alias("component"))
    crossing = _crossing(placed, classes, join)
    drop(tiles, parts)
    more = check_pairs(rows, classes, crossing, join)
    drop(crossing, classes)
    whole = connected_components(links.union(more))
    drop(links, more)

    done = members.join(whole, F.col("rep") == F.col("node"), "left").select("id", "n", F.coalesce("component", "rep").alias("component"))
    return done.select(_back("id").alias(key), F.col("n").alias("n_shingles"), _back("component").alias("component_id"))


def link_classes(df: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members): all links (a, b), a < b, between classes of equal sets, each named by its smallest key, and (key, n_shingles, class_id) of each row.

    Every pair of classes that links is there once, so the work grows with the number of links between different sets; copies are not expanded.
    Nulls, repeated rows and texts without words as in join_documents.
    """
    ship_package(df.sparkSession)
    rows = df.select(_ids(df, key).alias("id"), df[text].alias("text"))
    members, classes, tiles = _classes(rows, join)
    crossing = _crossing(tiles.withColumn("component", F.col("rep")), classes, join)
    drop(tiles)
    links = check_pairs(rows, classes, crossing, join)
    drop(crossing, classes)
    named = members.select(_back("id").alias(key), F.col("n").alias("n_shingles"), _back("rep").alias("class_id"))
    return links.filter("a != b").select(_back("a").alias("a"), _back("b").alias("b")), named


def keep_first(df: DataFrame, join: Join = Join(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with one row of each component: that of the smallest key. Rows that repeat key and text count as one document.

    Texts without words link with nothing and stay; all columns stay.
    """
    linked = join_documents(df, join, key, text)
    first = linked.filter(F.col(key).eqNullSafe(F.col("component_id"))).select(F.col(key).alias("_first")).distinct()
    once = Window.partitionBy("_key", "_body").orderBy("_body")
    rows = df.select(F.struct(*df.columns).alias("_row"), F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_body"))
    kept = rows.join(first, F.col("_key").eqNullSafe(F.col("_first")), "left_semi")
    return kept.withColumn("_n", F.row_number().over(once)).filter("_n = 1").select("_row.*")

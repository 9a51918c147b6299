"""Document fingerprints from closed syncmers, with DataFrame functions only.

A k-mer is a run of k words; characters of scripts without spaces, and of very long words, are words of their own. It is an anchor if the
smallest of its inner s-mers, by hash, is its first or its last: whether a k-mer is chosen depends on its own words alone, so equal passages
have equal anchors wherever they stand.

Anchors are matched by position: a link is an anchor, the next one and the words between their places, so two texts share a link where
both anchors stand at the same distance, that is, where one shift lays one text over the other. The fingerprint is the set of all links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, S = 8, 2
#: Code points of a word at most; a longer one (base64, minified code) is taken by its characters.
LONG = 20
#: Characters of scripts that are written without spaces: Thai and Lao, Burmese, Khmer, kana, Han.
UNSPACED = r"[\x{E00}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{3FFFF}]"
#: Rows of a bucket of neighbouring keys, about, buckets at most (larger ones beyond that: 400 MB at 100 TB of text), and percentiles of the keys at most.
ROWS, BUCKETS, COARSE = 512, 1 << 18, 4096
_FIRST = -(2**63)


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """Add out: array of (hash long, pos int) of the closed syncmers of a text, by position; k is s + 2 at least.

    A text of fewer than k words, or of which no k-mer is chosen, has one anchor, all its words; a null text or one without words has none.
    """
    runs, words, inner, count = f"_{out}_r", f"_{out}_w", f"_{out}_s", k - s + 1
    body = F.coalesce(F.col(text), F.lit(""))
    unspaced = (F.octet_length(body) > F.length(body)) & body.rlike(UNSPACED)
    body = F.when(unspaced, F.regexp_replace(body, f"({UNSPACED})", " $1 ")).otherwise(body)
    step = df.withColumn(runs, F.filter(F.split(body, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    short = F.flatten(F.transform(F.col(runs), lambda w: F.when(F.length(w) > LONG, F.split(w, "")).otherwise(F.array(w))))
    some_long = F.exists(F.col(runs), lambda w: F.length(w) > LONG)
    step = step.withColumn(words, F.when(some_long, short).otherwise(F.col(runs)))
    step = step.withColumn(inner, F.transform(F.col(words), lambda w, i: F.xxhash64(w, *(F.get(F.col(words), i + j) for j in range(1, s)))))

    def chosen(_: Column, i: Column) -> Column:
        at = [F.get(F.col(inner), i + j) for j in range(count)]
        edge = F.least(at[0], at[-1]) <= (F.least(*at[1:-1]) if count > 3 else at[1])
        whole = F.xxhash64(F.slice(F.col(words), i + 1, k))
        return F.when((i <= F.size(F.col(words)) - k) & edge, F.struct(whole.alias("hash"), i.alias("pos")))

    few = F.array(F.struct(F.xxhash64(F.col(words)).alias("hash"), F.lit(0).alias("pos")))
    step = step.withColumn(out, F.filter(F.transform(F.col(inner), chosen), lambda a: a.isNotNull()))
    step = step.withColumn(out, F.when(F.size(F.col(out)) > 0, F.col(out)).when(F.size(F.col(words)) > 0, few).otherwise(F.slice(few, 1, 0)))
    return step.drop(runs, words, inner)


def links(anchors: Column) -> Column:
    """The distinct links of anchors, sorted: hashes of an anchor, the next and their distance; the last anchor is a link by itself."""
    following = lambda i: F.get(anchors, i + 1)
    return F.sort_array(F.array_distinct(F.transform(anchors, lambda a, i: F.xxhash64(a["hash"], following(i)["hash"], following(i)["pos"] - a["pos"]))))


def as_string(hashes: Column) -> Column:
    """The hashes in hexadecimal, 16 digits each, one after another."""
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of links: 1 for equal sets only. Two empty sets are alike (1), an empty one and another are not (0)."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def _bucketed(rows: DataFrame) -> DataFrame:
    """Add bucket: rows (order_id, tie) in ascending order have ascending buckets, which follow the number of rows.

    The driver sees COARSE approximate percentiles of the keys at most, so sparse keys do as well as dense ones. Between two of them buckets are of equal width; a key that is a
    percentile several times over is split by tie, in as many as its share of the rows asks for. Only keys that lie in clumps between two percentiles can share a bucket with many: with
    those between the two, one in COARSE of all rows.
    """
    ids = rows.select("order_id")
    wanted = max(1, min(BUCKETS, ids.count() // ROWS))
    coarse = min(COARSE, wanted)
    fine, steps = -(-wanted // coarse), [i / coarse for i in range(1, coarse)]
    if not steps:
        return rows.withColumn("bucket", F.lit(0).cast("long"))
    found, lowest = ids.agg(F.percentile_approx("order_id", steps, 16 * coarse), F.min("order_id")).first()
    bounds = sorted({lowest, *found})  # each row is at one of them or beyond
    # Bits of tie of a bound, if it is a key of many rows.
    bits = [max(6, (found.count(x) * fine).bit_length()) if found.count(x) > 1 else 0 for x in bounds]
    # The smallest long has no literal of its own: it is one less than the next.
    listed = lambda values: F.expr("array(" + ", ".join(f"({x + 1}L - 1L)" for x in values) + ")")
    own, key, at = listed(bounds), F.col("order_id"), F.col("_place") - 1
    jumps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    further = lambda place, jump: F.when((place + jump <= len(bounds)) & (F.get(own, place + jump - 1) <= key), place + jump).otherwise(place)

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("_place", F.aggregate(F.array(*(F.lit(j) for j in jumps)), F.lit(0), further))
        return df.withColumn("_bits", F.when(F.get(own, at) == key, F.get(F.expr(f"array({', '.join(map(str, bits))})"), at)).otherwise(0))

    # Where the keys of a place, but the many of one, really begin and end.
    ends = {r[0]: r[1:] for r in placed(ids).filter("_bits = 0").groupBy("_place").agg(F.min("order_id"), F.max("order_id")).collect()}
    low, high = (F.get(listed([ends.get(i + 1, (x, x))[side] for i, x in enumerate(bounds)]), at).cast("double") for side in (0, 1))
    share = F.floor((key.cast("double") - low) / F.greatest(high - low, F.lit(1.0)) * fine)
    inside = F.when(F.col("_bits") > 0, F.expr("shiftright(tie, 64 - _bits) + shiftleft(1L, _bits - 1)")).otherwise(BUCKETS + F.least(F.greatest(share, F.lit(0)), F.lit(fine)))
    return placed(rows).withColumn("bucket", F.col("_place").cast("long") * (4 * BUCKETS) + inside).drop("_place", "_bits")


def _guards(rows: DataFrame) -> DataFrame:
    """A row for each bucket in use: the first row of the next one in use, after the last of the first. Of one row for each bucket, a few times BUCKETS at most,
    the order is found in one task; texts are fetched by keys."""
    heads = rows.groupBy("bucket").agg(F.min(F.struct("order_id", "tie")).alias("head"))
    order = Window.orderBy("bucket")
    after = heads.select("bucket", F.coalesce(F.lead("head").over(order), F.first("head").over(order)).alias("head"))
    keys = F.broadcast(after.select(F.col("bucket").alias("_bucket"), F.col("head.order_id").alias("_id"), F.col("head.tie").alias("_tie")))
    found = rows.join(keys, (F.col("order_id") == F.col("_id")) & (F.col("tie") == F.col("_tie")))
    return found.withColumn("bucket", F.col("_bucket")).drop("_bucket", "_id", "_tie").dropDuplicates(["bucket"])


def fingerprint_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last floor(n_chars / 2) code points replaced by the first of the next row's text by
    ascending key, then a hash of the text; after the last row comes the first. A null text is empty; null keys come first;
    of equal rows each is the next of another; a table of one row follows itself; an empty table gives no rows; other
    columns are left out. key is an integer, dense or sparse.
    """
    rows = df.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = _bucketed(rows.withColumns({"order_id": F.coalesce("id", F.lit(_FIRST)), "tie": F.xxhash64("body")}))
    both = rows.withColumn("guard", F.lit(False)).unionByName(_guards(rows).withColumn("guard", F.lit(True)))
    printed = with_anchors(both.repartition("bucket"), "body", "anchors").withColumn("print", links(F.col("anchors"))).drop("anchors")
    order = Window.partitionBy("bucket").orderBy("guard", "order_id", "tie")
    placed = printed.withColumn("after", F.lead(F.struct("body", "print")).over(order)).filter(~F.col("guard"))
    counted = placed.select("id", "body", "print", "after", F.length("body").cast("long").alias("n_chars"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = counted.withColumn("edited", F.concat(F.substring(F.col("body"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("after.body"), F.lit(1), half)))
    slim = edited.select("id", "n_chars", "print", F.col("after.print").alias("next_print"), "edited")
    done = with_anchors(slim, "edited", "anchors").withColumn("edited_print", links(F.col("anchors")))
    return done.select(
        F.col("id").cast(df.schema[key].dataType).alias(key),
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_string(F.col("print")).alias("fingerprint"),
        as_string(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print")).alias("near_next"),
    )

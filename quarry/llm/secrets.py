"""Secret scans with multipart credential linking, with DataFrame functions only.

Strong parts (assigned secrets, access identifiers, long hex runs) are reported by themselves. Weak parts (short access identifiers,
names of keys and clients, mixed strings, endpoints) are joined by interval with the other parts of their text, and reported only
where complementary parts stand side by side within a scope: an identifier or an endpoint with a secret, a secret with either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import cut, drop

#: Code points between two parts that still belong to one credential.
SCOPE = 200
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
NAMED = r"""((?i:access_?key_?id|client_?id|user_?name|account_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@-]+)"""
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{16,}={0,2}"
ENDPOINT = r"""https?://[^\x20\x09-\x0D"'<>]+"""
#: Kinds in the order in which spans of one start are listed; what they are a part of.
STRONG = ["assign", "access", "hex"]
WEAK = ["weak_access", "weak_secret", "endpoint"]
CHUNK = 256


def running(lengths: Column) -> Column:
    """The sums of all elements before each, in chunks so that the work stays in proportion to the elements."""
    number = F.ceil(F.size(lengths) / CHUNK).cast("int")
    none = F.lit(None).cast("array<long>")
    chunks = F.when(F.size(lengths) > 0, F.transform(F.sequence(F.lit(0), number - 1), lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)))).otherwise(F.array().cast("array<array<long>>"))

    def append(values: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("sum"), F.slice(F.array(F.lit(0).cast("long")), 1, 0).alias("before"))
        return F.aggregate(values, zero, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.concat(a["before"], F.array(a["sum"])).alias("before")), lambda a: a["before"])

    inside = F.transform(chunks, append)
    starts = append(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)))
    return F.coalesce(F.flatten(F.zip_with(inside, starts, lambda own, base: F.transform(own, lambda x: x + base))), none)


def with_spans(df: DataFrame, text: str, pattern: str, out: str, group: int = 0, least: int = 0, when: Column | None = None) -> DataFrame:
    """Add out: array of (start, end) of the leftmost non-overlapping matches whose group has `least` code points; null if there is none.

    Positions are code points. They come from the lengths of the matches and of the pieces between them.
    """
    found = F.col(text).rlike(pattern) if when is None else when & F.col(text).rlike(pattern)
    long_lengths = lambda a: F.transform(a, lambda x: F.length(x).cast("long"))
    p, m, g, at = (f"_{out}_{x}" for x in ("p", "m", "g", "at"))
    step = df.withColumn(f"_{out}_f", found)
    step = step.withColumns({
        p: F.when(F.col(f"_{out}_f"), long_lengths(F.split(F.col(text), pattern, -1))),
        m: F.when(F.col(f"_{out}_f"), long_lengths(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))),
        g: F.when(F.col(f"_{out}_f"), long_lengths(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)))) if group else F.lit(None).cast("array<long>"),
    })
    both = F.zip_with(F.slice(F.col(p), F.lit(1), F.size(F.col(m))), F.col(m), lambda a, b: a + b)
    step = step.withColumn(at, F.when(F.col(f"_{out}_f"), running(both)))
    spans = F.transform(F.col(m), lambda n, i: F.struct((F.get(F.col(at), i) + F.get(F.col(p), i)).alias("start"), (F.get(F.col(at), i) + F.get(F.col(p), i) + n).alias("end"), F.coalesce(F.get(F.col(g), i), n).alias("size")))
    kept = F.transform(F.filter(spans, lambda s: s["size"] >= least), lambda s: F.struct(s["start"], s["end"]))
    step = step.withColumn(out, F.when(F.size(kept) > 0, kept))
    return step.drop(f"_{out}_f", p, m, g, at)


def _listed(kinds: list[str], columns: dict[str, Column]) -> Column:
    """All spans as (start, order of kind, kind, end), sorted."""
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")

    def named(kind: str, rank: int) -> Column:
        return F.transform(columns[kind], lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end")))

    parts = [F.coalesce(named(k, i), none) for i, k in enumerate(kinds)]
    return F.sort_array(F.concat(*parts))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _beside(parts: DataFrame, others: DataFrame, scope: int, how: str = "left_semi") -> DataFrame:
    """The parts that have one of the others within scope in the same text, but not over it: an interval join, on the cells that both touch. With
    how="left_anti", the parts that lie over none of the others."""
    width = max(scope, 1)
    cell = lambda low, high: F.sequence(F.floor(low / width), F.floor(high / width))
    a = parts.withColumn("cell", F.explode(cell(F.col("start") - scope, F.col("end") + scope)))
    b = others.select(F.col("id").alias("_id"), F.col("body_hash").alias("_hash"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.explode(cell(F.col("start"), F.col("end"))).alias("_cell"))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("body_hash") == F.col("_hash")) & (F.col("cell") == F.col("_cell"))
    apart = (F.col("_start") >= F.col("end")) | (F.col("_end") <= F.col("start"))
    if how == "left_semi":
        found = a.join(b, same & apart & (F.col("_start") <= F.col("end") + scope) & (F.col("_end") >= F.col("start") - scope), "left_semi")
        return found.drop("cell").distinct()
    over = a.join(b, same & ~apart, "left_semi").drop("cell").distinct()
    return parts.join(over.select("id", "body_hash", "start", "end", "kind"), _same_part(parts, over), "left_anti").distinct()


def _same_part(a: DataFrame, b: DataFrame) -> Column:
    return a["id"].eqNullSafe(b["id"]) & (a["body_hash"] == b["body_hash"]) & (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["kind"] == b["kind"])


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """Per row: key, base (strong spans) and linked (weak spans with their complements near): arrays of (start, rank, kind, end).

    A null text is empty and has no spans; equal rows get equal spans; a null key is kept; an empty table gives no rows; other
    columns are left out. Weak access identifiers and endpoints need a secret within scope, weak secrets an access identifier or an endpoint. Parts that lie over each
    other do not complement each other, and a mixed string over an identifier or a strong part is no weak secret.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    step = df.select(F.col(key).alias("id"), body.alias("body"))
    step = with_spans(step, "body", ASSIGN, "assign", 2, 6)
    step = with_spans(step, "body", ACCESS, "akia", when=F.contains(F.col("body"), F.lit("AKIA")))
    step = with_spans(step, "body", HEX, "hex")
    step = with_spans(step, "body", NAMED, "named", 2, 4)
    fits = lambda low: F.filter(F.col("akia"), lambda s: (s["end"] - s["start"] >= 20) if low else (s["end"] - s["start"] < 20))
    full = lambda a: F.when(F.size(a) > 0, a)
    step = step.withColumns({"access": full(fits(True)), "weak_access": full(F.concat(F.coalesce(fits(False), F.array().cast("array<struct<start:bigint,end:bigint>>")), F.coalesce("named", F.array().cast("array<struct<start:bigint,end:bigint>>"))))})
    any_access = F.col("access").isNotNull() | F.col("weak_access").isNotNull()
    any_address = F.contains(F.col("body"), F.lit("://"))
    step = with_spans(step, "body", MIXED, "weak_secret", when=any_access | any_address)
    any_secret = F.col("assign").isNotNull() | F.col("hex").isNotNull() | F.col("weak_secret").isNotNull()
    step = with_spans(step, "body", ENDPOINT, "endpoint", when=any_address & any_secret)
    found = cut(step.select("id", F.xxhash64("body").alias("body_hash"), *STRONG, *WEAK), "secrets")

    parts = found.filter(F.coalesce(*WEAK).isNotNull()).select("id", "body_hash", F.explode(_listed([*STRONG, *WEAK], {k: F.col(k) for k in [*STRONG, *WEAK]})).alias("s")).select("id", "body_hash", "s.*")
    parts = cut(parts.distinct(), "parts")
    kinds = lambda *names: parts.filter(F.col("kind").isin(*names))
    mixed = cut(_beside(kinds("weak_secret"), kinds(*STRONG, "weak_access"), 0, "left_anti"), "mixed")
    secret = kinds("assign", "hex").union(mixed)
    linked = _beside(kinds("weak_access", "endpoint"), secret, scope)
    linked = cut(linked.union(_beside(mixed, kinds("access", "weak_access", "endpoint"), scope)), "linked")
    drop(parts, mixed)
    grouped = linked.groupBy(F.col("id").alias("_id"), F.col("body_hash").alias("_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("linked"))
    joined = found.join(grouped, F.col("id").eqNullSafe(F.col("_id")) & (F.col("body_hash") == F.col("_hash")), "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return joined.select(F.col("id").alias(key), _listed(STRONG, {k: F.col(k) for k in STRONG}).alias("base"), F.coalesce("linked", none).alias("linked"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of find_secrets: key, n_assign, n_access, n_hex, base_sha256, spans."""
    count = lambda k: F.size(F.filter(F.col("base"), lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(key, *(count(k) for k in STRONG), F.sha2(F.encode(_joined(F.col("base")), "UTF-8"), 256).alias("base_sha256"), _joined(F.sort_array(F.concat("base", "linked"))).alias("spans"))

"""Personal data and information-theoretic sanitisation.

Patterns find the protected entities. Corpus co-occurrence then estimates how strongly a term reveals an entity: the pointwise mutual
information of the two against the information of the entity itself, over different texts. Terms that exceed a threshold are found
too, wherever they stand in a text that holds the entity; the sanitised text generalises them, or removes them beyond a second threshold.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.prefilter import split_possible
from quarry.llm.words import slices
from quarry.session import cut, drop, ship_package

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
#: Bits of the filter that keeps terms that cannot disclose anything out of the corpus counts.
FILTER_BITS = 1 << 20
#: Terms of an Arrow batch of mentions at most.
MENTION_ROWS = 20_000


@dataclass(frozen=True)
class Policy:
    """window: characters on either side of an entity, or of a term far from it, that are its context; support: texts and contexts that a pair needs;
    generalise, remove: the share of an entity's information from which a term is generalised or removed."""

    window: int = 60
    support: int = 3
    generalise: float = 0.85
    remove: float = 0.97


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long runs of other characters are read once."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if at >= end:
            begin = at
            while begin > end and text[begin - 1] in _LOCAL:
                begin -= 1
            domain = _DOMAIN.match(text, at + 1) if begin < at else None
            if domain:
                end = domain.end()
                out.append((begin, end))
        at = text.find("@", at + 1)
    return out


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def find_base(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then start."""
    out = [("email", b, e) for b, e in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{b}:{e}" for k, b, e in spans)


def _context(text: str, spans: list[tuple[int, int]], window: int) -> str:
    """Names the surroundings of spans: copies of a passage are one context."""
    return hashlib.blake2b("\0".join(text[max(0, b - window) : e + window] for b, e in spans).encode(), digest_size=8).hexdigest()


def _outside(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(term, start, end) of the terms outside all entities, by start."""
    covered = np.zeros(len(text) + 1, bool)
    for _, b, e in base:
        covered[b:e] = True
    return ((m[0].lower(), m.start(), m.end()) for m in _TERM.finditer(text) if not covered[m.start()] and not covered[m.end() - 1])


def nearby_terms(text: str, base: list[tuple[str, int, int]], window: int) -> set[tuple[str, str, str]]:
    """(entity, term, context) of whole terms within window of an entity and outside all entities; the context is the entity's."""
    terms = list(_outside(text, base)) if base else []
    starts = [b for _, b, _ in terms]
    out = set()
    for kind, b, e in base:
        low, high = max(0, b - window), min(len(text), e + window)
        context = _context(text, [(b, e)], window)
        out.update((f"{kind}:{text[b:e]}", term, context) for term, _, end in terms[bisect_left(starts, low) : bisect_left(starts, high)] if end <= high)
    return out


def terms_outside(text: str, base: list[tuple[str, int, int]]) -> set[str]:
    """The different terms that stand outside all entities."""
    if not base:
        return {term.lower() for term in set(_TERM.findall(text))}
    return {term for term, _, _ in _outside(text, base)}


def scan(df: DataFrame, policy: Policy, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, body_hash, counts by kind, base (joined spans), entities, near: the terms by entities, with the entity's context."""
    ship_package(df.sparkSession)
    near = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("context", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            hashes, counts, bases, entities, terms = [], [], [], [], []
            for raw in texts:
                t = raw.decode()
                base = find_base(t)
                hashes.append(hashlib.md5(raw, usedforsecurity=False).hexdigest())
                counts.append([sum(k == kind for k, _, _ in base) for kind in KINDS])
                bases.append(joined(base))
                entities.append(sorted({f"{k}:{t[b:e]}" for k, b, e in base}))
                terms.append([dict(zip(("entity", "term", "context"), x, strict=True)) for x in sorted(nearby_terms(t, base, policy.window))])
            table = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(hashes, pa.string()), *(pa.array(table[:, i]) for i in range(len(KINDS))), pa.array(bases, pa.string()), pa.array(entities, pa.list_(pa.string())), pa.array(terms, near)],
                ["id", "body_hash", *(f"n_{k}" for k in KINDS), "base", "entities", "near"],
            )

    kind = df.schema[key].dataType.simpleString()
    schema = f"id {kind}, body_hash string, {', '.join(f'n_{k} long' for k in KINDS)}, base string, entities array<string>, near array<struct<entity:string,term:string,context:string>>"
    return df.select(df[key].alias("id"), df[text].alias("text")).mapInArrow(run, schema)


def mentions(df: DataFrame, holding: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """(body_hash, term, context, spans): all terms outside entities of the different texts in holding, with the place of every mention."""
    kept = df.sparkSession.sparkContext.broadcast(_bits(holding, "body_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bits = np.unpackbits(kept.value).view(bool)

        def rows() -> Iterator[tuple[str, str, str, list[tuple[int, int]]]]:
            for _, texts in slices(batches):
                for raw in texts:
                    name = hashlib.md5(raw, usedforsecurity=False).hexdigest()
                    if open_bits[zlib.crc32(name.encode()) % FILTER_BITS]:
                        t = raw.decode()
                        places: dict[str, list[tuple[int, int]]] = {}
                        for term, b, e in _outside(t, find_base(t)):
                            places.setdefault(term, []).append((b, e))
                        yield from ((name, term, _context(t, spans, policy.window), spans) for term, spans in places.items())

        found = rows()
        while some := list(islice(found, MENTION_ROWS)):
            flat = np.array([x for r in some for x in r[3]], np.int64).reshape(-1, 2)
            offsets = pa.array(np.cumsum([0, *(len(r[3]) for r in some)]), pa.int32())
            spans = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"]))
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in some], pa.string()) for i in range(3)), spans], ["body_hash", "term", "context", "spans"])

    found = df.select(df[text].alias("text")).mapInArrow(run, "body_hash string, term string, context string, spans array<struct<start:long,end:long>>")
    return found.join(holding.select("body_hash").distinct(), "body_hash", "left_semi").dropDuplicates(["body_hash", "term"])


def _bits(names: DataFrame, column: str) -> np.ndarray:
    """FILTER_BITS bits, of which those of the names in column are set: FILTER_BITS / 64 rows at most come to the driver."""
    bit = F.crc32(F.encode(column, "UTF-8")) % FILTER_BITS
    marked = names.select(bit.alias("b"))
    words = np.zeros(FILTER_BITS // 64, np.int64)
    for word, ones in marked.groupBy(F.expr("cast(b div 64 as int)").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))"))).collect():
        words[word] = ones
    return np.packbits(np.unpackbits(words.astype("<i8").view(np.uint8), bitorder="little"))


def term_counts(df: DataFrame, wanted: DataFrame, copied: DataFrame, most: float, text: str = "text") -> DataFrame:
    """(term, n_term): in how many different texts each wanted term stands outside all entities. Counts cover all rows; a count
    beyond most may be less than the true one, but is beyond most.

    Filters of FILTER_BITS bits, whatever the number of terms and rows, keep most other words from being counted and most texts without a
    copy from being told apart by their hash (copied: body_hash of texts of several rows). What they let pass is dropped by the join, or counted once as it should.
    """
    spark = df.sparkSession
    allowed, twice = (spark.sparkContext.broadcast(_bits(*x)) for x in ((wanted, "term"), (copied, "body_hash")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_bits, copy_bits = np.unpackbits(allowed.value).view(bool), np.unpackbits(twice.value).view(bool)
        passed: dict[str, bool] = {}
        # Counts of this task from texts without copies; they are all emitted, so a term beyond most needs no further counting.
        sure: dict[str, int] = {}
        task = TaskContext.get().partitionId()
        for part, (_, texts) in enumerate(slices(batches)):
            once: dict[str, int] = {}
            groups = {f"{task}:{part}": once}
            for raw in texts:
                t, name = raw.decode(), hashlib.md5(raw, usedforsecurity=False).hexdigest()
                if name in groups:
                    continue
                counts = once
                if copy_bits[zlib.crc32(name.encode()) % FILTER_BITS]:
                    counts = groups[name] = {}
                for term in terms_outside(t, find_base(t)):
                    ok = passed.get(term)
                    if ok is None:
                        if len(passed) > 500_000:
                            passed.clear()
                        ok = passed[term] = bool(open_bits[zlib.crc32(term.encode()) % FILTER_BITS])
                    if ok and sure.get(term, 0) <= most:
                        counts[term] = counts.get(term, 0) + 1
                        if counts is once:
                            sure[term] = sure.get(term, 0) + 1
            full = {k: v for k, v in groups.items() if v}
            terms, counts = pa.array([list(v) for v in full.values()], pa.list_(pa.string())), pa.array([list(v.values()) for v in full.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(list(full), pa.string()), terms, counts], ["own", "terms", "counts"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, int] = {}

        def row() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([list(sums)], pa.list_(pa.string())), pa.array([list(sums.values())], pa.list_(pa.int64()))], ["terms", "counts"])
            sums.clear()
            return out

        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term, n in zip(terms, counts, strict=True):
                    sums[term] = sums.get(term, 0) + n
                if len(sums) > 100_000:
                    yield row()
        yield row()

    # A row for each slice with the counts of texts that have no copy, and one for each text that may have some, of which one stays; a task's rows are
    # added up before they are taken apart.
    found = df.select(df[text].alias("text")).mapInArrow(run, "own string, terms array<string>, counts array<long>").dropDuplicates(["own"])
    found = found.select("terms", "counts").mapInArrow(merged, "terms array<string>, counts array<long>").select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n_term"))
    return found.join(wanted.select("term").distinct(), "term")


def disclosures(df: DataFrame, scanned: DataFrame, policy: Policy, text: str = "text") -> DataFrame:
    """(body_hash, start, end, share): every mention of a term in the texts that hold an entity which it reveals, with the share of its
    information that it gives.

    share = PMI(term; entity) / information of the entity = 1 + log(n_pair / n_term) / log(n_rows / n_entity); all four count different
    texts, so that copies neither prove nor disprove anything, and the two may stand anywhere in a text. A pair needs support different
    texts, and support different contexts in them: those of the entity in texts where the term is near, and that of the term in each text
    where it is not. Pairs of fewer texts go before terms are counted over the corpus: what is counted are terms that recur with an entity, and
    nothing is if none does. Entities that stand in the same texts are one class, and so are terms: classes are paired, so copies of a list of contacts do not
    bring each contact together with each word.
    """
    texts = scanned.groupBy("body_hash").agg(F.count(F.lit(1)).alias("n"))
    n_rows = F.lit(float(texts.count()))
    held = scanned.select("body_hash", F.explode("entities").alias("entity")).distinct()
    # An entity of fewer texts than support has no pair with support.
    entities = cut(_classes(held, "entity", policy.support).withColumnsRenamed({"class": "e", "n": "n_entity"}), "entities")
    holding = cut(held.join(entities, "entity").select("body_hash", "e", "n_entity").distinct(), "holding")
    none = df.sparkSession.createDataFrame([], "body_hash string, start long, end long, share double")
    if holding.isEmpty():
        drop(entities, holding)
        return none
    found = cut(mentions(df, holding, policy, text), "mentions")
    terms = cut(_classes(found, "term", policy.support).select("term", F.col("class").alias("t")), "terms")
    # n_pair is n_entity at most: pairs with more n_term than this cannot reach the share.
    rarity = F.greatest(n_rows / F.col("n_entity"), F.lit(2.0))
    most = F.col("n_entity") * F.pow(rarity, F.lit(1 - policy.generalise)) * 1.000001
    together = found.select("body_hash", "term").join(terms, "term").select("body_hash", "t").distinct().join(holding, "body_hash")
    recurring = cut(together.groupBy("e", "t", "n_entity").agg(F.count(F.lit(1)).alias("n_pair")).filter(F.col("n_pair") >= policy.support), "recurring")
    if recurring.isEmpty():
        drop(entities, holding, found, terms, recurring)
        return none
    wanted = cut(terms.join(recurring.select("t").distinct(), "t"), "wanted")
    counts = cut(term_counts(df, wanted, texts.filter("n > 1"), holding.agg(F.max(most)).first()[0] or 0.0, text), "counts")
    share = 1 + F.log(F.col("n_pair") / F.col("n_term")) / F.log(rarity)
    likely = recurring.join(wanted.join(counts, "term"), "t").filter(F.col("n_term") <= most).select("e", "term", share.alias("share")).filter(F.col("share") >= policy.generalise)
    likely = cut(likely, "likely")
    # Each mention of a likely term in a text that holds an entity of the class.
    pairs = cut(found.select("body_hash", "term", "context").join(likely, "term").join(holding.select("body_hash", "e"), ["body_hash", "e"], "left_semi"), "pairs")
    spans = cut(_told(scanned, entities, likely, pairs, policy).join(found.select("body_hash", "term", "spans"), ["body_hash", "term"]).select("body_hash", "share", F.explode("spans").alias("s")).select("body_hash", "s.start", "s.end", "share"), "spans")
    drop(entities, holding, found, terms, recurring, wanted, counts, likely, pairs)
    return spans


def _classes(rows: DataFrame, name: str, support: int) -> DataFrame:
    """(name, class, n) of the names that stand in support different texts or more; n: their number. Names that stand in the same texts are one class, named by that number
    and 128 bits of the set, so that what depends on the texts alone is worked out once for all of them."""
    bits = [F.bit_xor(F.xxhash64(F.lit(i), "body_hash")) for i in (1, 2)]
    grouped = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"), *(b.alias(f"_{i}") for i, b in enumerate(bits)))
    return grouped.filter(F.col("n") >= support).select(name, F.concat_ws("_", "n", "_0", "_1").alias("class"), "n")


def _told(scanned: DataFrame, entities: DataFrame, likely: DataFrame, pairs: DataFrame, policy: Policy) -> DataFrame:
    """(body_hash, term, share): likely terms that have support different contexts with an entity, in the texts of both, with their greatest share.

    With an entity that it is never near, a term's contexts are its own, whatever the entity of a class; such an entity is there if fewer of the class are near than it
    has. Entities and terms that are near each other are looked at one by one; there are no more of them than words.
    """
    close = scanned.select("body_hash", F.explode("near").alias("m")).select("body_hash", "m.entity", "m.term", F.col("m.context").alias("near")).distinct()
    close = cut(close.join(entities.select("entity", "e"), "entity").join(likely.select("e", "term"), ["e", "term"], "left_semi"), "close")
    by_pair = cut(close.select("e", "entity", "term").distinct(), "by_pair")
    own = by_pair.join(pairs.select("e", "term", "body_hash", "context"), ["e", "term"]).join(close.drop("e"), ["body_hash", "entity", "term"], "left")
    near = own.groupBy("e", "entity", "term").agg(F.count_distinct(F.coalesce("near", "context")).alias("n")).filter(F.col("n") >= policy.support).select("e", "term").distinct()
    sizes = entities.groupBy("e").agg(F.count(F.lit(1)).alias("size"))
    far = pairs.groupBy("e", "term").agg(F.count_distinct("context").alias("n")).filter(F.col("n") >= policy.support)
    far = far.join(sizes, "e").join(by_pair.groupBy("e", "term").agg(F.count(F.lit(1)).alias("near")), ["e", "term"], "left").filter("coalesce(near, 0) < size").select("e", "term")
    proved = cut(near.union(far).distinct(), "proved")
    told = cut(pairs.join(proved, ["e", "term"], "left_semi").groupBy("body_hash", "term").agg(F.max("share").alias("share")), "told")
    drop(close, by_pair, proved)
    return told


def find_personal(df: DataFrame, policy: Policy = Policy(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_email, n_ip, n_card, n_phone, base (joined spans), terms: array of (start, end, share) that reveal entities of the text.

    A null text is empty and has no spans; equal rows get equal spans; null keys are kept; an empty table gives no rows;
    other columns are left out. Scan results, without the texts, and the terms of texts whose entities may be revealed are written once to the shared folder.
    """
    scanned = cut(scan(df, policy, key, text), "personal")
    spans = disclosures(df, scanned, policy, text)
    grouped = spans.groupBy(F.col("body_hash").alias("_hash")).agg(F.sort_array(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,share:double>>")
    return scanned.join(grouped, F.col("body_hash") == F.col("_hash"), "left").select(F.col("id").alias(key), "body_hash", *(f"n_{k}" for k in KINDS), "base", F.coalesce("terms", none).alias("terms"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digests of find_personal: key, counts, base_sha256, spans (term spans last, as a fifth kind)."""
    terms = F.array_join(F.transform("terms", lambda s: F.concat_ws(":", F.lit("term"), s["start"].cast("string"), s["end"].cast("string"))), ",")
    parts = F.filter(F.array("base", terms), lambda p: p != "")
    return found.select(key, *(f"n_{k}" for k in KINDS), F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), F.array_join(parts, ",").alias("spans"))


def mask(text: str, base: str, terms: list[tuple[int, int, float]], remove: float) -> str:
    """The text with entities replaced by their kind in brackets, and terms generalised to [TERM] or removed."""
    spans = [(int(b), int(e), f"[{k.upper()}]") for k, b, e in (s.split(":") for s in base.split(",") if s)]
    spans += [(b, e, "" if share >= remove else "[TERM]") for b, e, share in terms]
    out, at = [], 0
    for b, e, put in sorted(spans):
        if b >= at:
            out += [text[at:b], put]
        elif e > at:
            out.append(put)
        at = max(at, e)
    return "".join([*out, text[at:]])


def sanitize(df: DataFrame, policy: Policy = Policy(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with its text sanitised; all rows and columns stay. Null texts stay null.

    Rows with something to mask, and few others, are joined to their spans by key and text hash; all others stay where they are.
    """
    found = find_personal(df, policy, key, text).filter("base != '' or size(terms) > 0")
    spans = found.select(F.col(key).alias("_id"), F.col("body_hash").alias("_hash"), F.col("base").alias("_base"), F.col("terms").alias("_terms")).distinct()
    ship_package(df.sparkSession)
    remove = policy.remove
    columns = df.columns

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            texts, bases, terms = (batch.column(i).to_pylist() for i in range(3))
            new = [t if t is None or b is None else mask(t, b, [(s["start"], s["end"], s["share"]) for s in x], remove) for t, b, x in zip(texts, bases, terms, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == text else batch.column(names.index(f"c_{n}")) for n in columns], columns)

    body = F.md5(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8"))
    rows = df.select(F.struct(*columns).alias("_row"), F.col(key).alias("_key"), body.alias("_own"))
    spans = cut(spans, "masks")
    some, others = split_possible(rows, "_own", spans, "_hash")
    joined_rows = some.join(spans, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_hash")), "left")
    row = F.col("_row")
    changed = joined_rows.select(row[text].alias("_t"), "_base", "_terms", *(row[c].alias(f"c_{c}") for c in columns if c != text)).mapInArrow(masked, df.schema)
    return changed.unionAll(others.select("_row.*"))

"""Substring dedup by relative Lempel-Ziv parsing.

Every document is both reference and input. Texts have anchors: in each window of `span` words the smallest hash of an inner run of words, so that equal
windows have equal anchors. The index maps each anchor to its first place in the corpus, (document, word); documents are kept as reference blocks
of BLOCK words and the span - 1 that follow, so that each window lies in one block.

A document is factored against the blocks that its anchors name. From each place that the index gives, the match is extended word by word to
both sides as far as it goes, over neighbouring blocks too; then the document is parsed greedily, at each place with the match that reaches
furthest. Matches of span words or more are duplicate spans. What lies at factor boundaries, windows that no such match holds but whose anchor
stands elsewhere too, is checked window by window: their hashes meet those of all other windows left over. A window's first document has
it left over, as no earlier one has the window, so nothing is missed.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.prefilter import only_possible
from quarry.llm.words import U64, Batch, mix, shingle_hashes, slices, span_hashes, span_sums
from quarry.session import cut, drop, ship_package

SPAN, ANCHOR, BLOCK = 50, 16, 128
NULL_ID = -(2**63)
_BASES = (0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25)
_PLACE = U64(32)


def find_anchors(batch: Batch, words: np.ndarray, span: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a batch: (doc, hash, place, first window, last window), by place. Places are words of the batch; a window is named by its first.

    The anchor of a window is the run of `anchor` words in it of the smallest hash, by its upper 32 bits, the leftmost of equal ones: a function of
    the window's words alone. Windows that share an anchor stand side by side, span - anchor + 1 at most.
    """
    none = np.empty(0, np.int64)
    windows, doc = batch.windows(span)
    if not len(windows):
        return none, none.astype(np.uint64), none, none, none
    grams = shingle_hashes(words, np.arange(len(words) - anchor + 1), anchor)
    width = span - anchor + 1
    least = (grams >> _PLACE << _PLACE) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while 2 * have <= width:
        least = np.minimum(least[: len(least) - have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    at = (least[windows] & U64(2**32 - 1)).astype(np.int64)
    edges = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    ends = np.r_[edges[1:], len(at)] - 1
    return doc[edges], grams[at[edges]], at[edges], windows[edges], windows[ends]


def _ids(df: DataFrame, key: str) -> Column:
    return F.coalesce(df[key].cast("long"), F.lit(NULL_ID))


def _listed(parts: list[np.ndarray], kind: pa.DataType | None = None) -> pa.ListArray:
    """A column of arrays."""
    offsets = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64), kind or pa.int64()))


def _per_text(batch: pa.RecordBatch, column: str) -> tuple[pa.Array, np.ndarray]:
    """The values of a column of arrays, and where those of each row begin, and the end."""
    lists = batch.column(batch.schema.get_field_index(column))
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.cumsum(np.r_[0, lengths]).astype(np.int64)


def anchors_of(rows: DataFrame, span: int, anchor: int) -> DataFrame:
    """Per row of span words or more: id, body (a hash that tells rows of one id apart), name (128 bits of its text), n (words), its anchors and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            b = Batch(texts)
            doc, grams, at, _, _ = find_anchors(b, b.hashes(), span, anchor)
            begin = np.searchsorted(doc, np.arange(b.n + 1))
            cutting = [slice(begin[i], begin[i + 1]) for i in range(b.n)]
            names = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            found = [_listed([grams[c].view(np.int64) for c in cutting]), _listed([at[c] - b.word_from[i] for i, c in enumerate(cutting)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(b.n_words), *found], ["id", "body", "name", "n", "anchors", "places"])

    return rows.select("id", "body", "text").mapInArrow(run, "id long, body long, name binary, n long, anchors array<long>, places array<long>").filter(F.size("anchors") > 0)


def reference_blocks(rows: DataFrame, span: int, block: int) -> DataFrame:
    """The blocks m of a row's `wanted`: id, body, m, words: those from m * block on, block + span - 1 at most, joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            wanted, begin = _per_text(batch, "wanted")
            wanted, row, out = wanted.to_numpy(), [], []
            for i, text in enumerate(texts):
                words = text.split()
                for m in wanted[begin[i] : begin[i + 1]]:
                    row.append(i)
                    out.append(b" ".join(words[m * block : (m + 1) * block + span - 1]))
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(wanted, pa.int64()), pa.array(out, pa.binary())], ["id", "body", "m", "words"])

    return rows.select("id", "body", "text", "wanted").mapInArrow(run, "id long, body long, m long, words binary")


def _of_texts(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """The texts that lists (id, body, more) has, once each, with its columns."""
    lists = lists.withColumnRenamed("id", "_id").withColumnRenamed("body", "_body")
    near = only_possible(rows, "id", lists, "_id")
    return near.join(lists, (F.col("id") == F.col("_id")) & (F.col("body") == F.col("_body"))).dropDuplicates(["id", "body"])


def _pieces(ids: list[tuple[int, int, int]], parts: list[np.ndarray], block: int) -> dict[tuple[int, int], list[tuple[int, np.ndarray]]]:
    """Stretches of reference words, (first word, words) by document, from its blocks (id, body, m): neighbouring blocks are one stretch."""
    out: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
    order = sorted(range(len(ids)), key=ids.__getitem__)
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and ids[order[to]][:2] == ids[order[to - 1]][:2] and ids[order[to]][2] == ids[order[to - 1]][2] + 1:
            to += 1
        run = order[at:to]
        out.setdefault(ids[run[0]][:2], []).append((ids[run[0]][2] * block, np.concatenate([*(parts[i][:block] for i in run[:-1]), parts[run[-1]]])))
        at = to
    return out


Match = tuple[int, int, int, int]


def find_matches(own: np.ndarray, hits: np.ndarray, pieces: dict[tuple[int, int], list[tuple[int, np.ndarray]]], span: int, anchor: int, block: int) -> list[Match]:
    """(start, end, reference id, start there) of the longest matches around hits, columns (place, reference id, body, place there).

    Hits of one document and shift lie on one diagonal; own words and the reference's are compared along it, beyond the first and last of neighbouring hits as
    well. Matches of fewer words than an anchor has do not count.
    """
    place, ref, body, there = hits
    shift = there - place
    order = np.lexsort((place, shift, body, ref))
    place, ref, body, shift = place[order], ref[order], body[order], shift[order]
    edges = np.flatnonzero(np.r_[True, (ref[1:] != ref[:-1]) | (body[1:] != body[:-1]) | (shift[1:] != shift[:-1]) | (place[1:] - place[:-1] > block), True])
    found = set()
    for i, j in zip(edges[:-1].tolist(), (edges[1:] - 1).tolist(), strict=True):
        d, low, high = int(shift[i]), int(place[i]) - block, int(place[j]) + span + block
        stretches = pieces.get((int(ref[i]), int(body[i])), [])
        for begin, words in stretches[max(0, bisect_right(stretches, low + d, key=lambda s: s[0]) - 1) :]:
            if begin - d >= high:
                break
            a, b = max(low, 0, begin - d), min(high, len(own), begin + len(words) - d)
            if b - a >= anchor:
                same = np.zeros(b - a + 2, np.int8)
                same[1:-1] = own[a:b] == words[a + d - begin : b + d - begin]
                turns = np.flatnonzero(np.diff(same))
                starts, ends = turns[::2], turns[1::2]
                found.update((a + int(s), a + int(e), int(ref[i]), a + int(s) + d) for s, e in zip(starts, ends, strict=True) if e - s >= anchor)
    return sorted(found)


def greedy_parse(matches: list[Match]) -> list[tuple[int, int, int, int]]:
    """Factors (start, length, reference id, start there), side by side: at each place the match that reaches furthest. Words of no match are in no factor."""
    out, at, i, best = [], 0, 0, (0, 0, 0, 0)
    while True:
        while i < len(matches) and matches[i][0] <= at:
            best = max(best, matches[i], key=lambda m: m[1])
            i += 1
        if best[1] > at:
            out.append((at, best[1] - at, best[2], best[3] + at - best[0]))
            at = best[1]
        elif i < len(matches):
            at = matches[i][0]
        else:
            return out


def parse_texts(given: DataFrame, span: int, anchor: int, block: int) -> DataFrame:
    """Per text with its hits (at, rid, rbody, rat, many) and the blocks they name (bid, bbody, bm, words): id, body, its factors (f_start, f_length, f_ref, f_at),
    its matches of span words or more (froms, tos), and its left windows (starts) with 128 bits that name them (w1, w2): those that no such match
    holds and whose anchor has more places than its first and this one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, limit=1 << 20):
            b = Batch(texts)
            words = b.hashes()
            doc, _, places, firsts, lasts = find_anchors(b, words, span, anchor)
            begin = np.searchsorted(doc, np.arange(b.n + 1))
            ids = batch.column(0).to_numpy()
            (at, h), *rest = (_per_text(batch, c) for c in ("at", "rid", "rbody", "rat", "many"))
            at, ref, rbody, rat, many = (x.to_numpy(zero_copy_only=False) for x in (at, *(r[0] for r in rest)))
            (bid, k), *more = (_per_text(batch, c) for c in ("bid", "bbody", "bm", "words"))
            named = list(zip(bid.to_pylist(), more[0][0].to_pylist(), more[1][0].to_pylist(), strict=True))
            r = Batch(more[2][0].to_pylist())
            rwords = r.hashes()
            stretch = [rwords[r.word_from[i] : r.word_from[i + 1]] for i in range(r.n)]
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for i in range(b.n):
                own, hit = words[b.word_from[i] : b.word_from[i + 1]], slice(h[i], h[i + 1])
                earlier = ref[hit] < ids[i]
                columns = np.stack([at[hit], ref[hit], rbody[hit], rat[hit]])
                matches = find_matches(own, columns[:, earlier], _pieces(named[k[i] : k[i + 1]], stretch[k[i] : k[i + 1]], block), span, anchor, block) if earlier.any() else []
                held = np.zeros(len(own) + 1, np.int64)
                full = [m for m in matches if m[1] - m[0] >= span]
                for m in full:
                    held[m[0]] += 1
                    held[m[1] - span + 1] -= 1
                mine = slice(begin[i], begin[i + 1])
                which = np.searchsorted(places[mine] - b.word_from[i], at[hit][many[hit]])
                low, high = firsts[mine][which] - b.word_from[i], lasts[mine][which] - b.word_from[i]
                count = high - low + 1
                left = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
                left = left[np.cumsum(held)[left] == 0]
                factors = np.array(greedy_parse(matches), np.int64).reshape(-1, 4)
                for column, values in zip(out, [left, *factors.T, np.array([m[0] for m in full], np.int64), np.array([m[1] for m in full], np.int64)], strict=True):
                    column.append(values)
            own_from = np.repeat(b.word_from[:-1], [len(x) for x in out[0]])
            flat = np.concatenate(out[0]) + own_from if out[0] else np.empty(0, np.int64)
            sums = [(base, span_sums(x, base)) for base, x in zip(_BASES, (words, mix(words ^ U64(_BASES[1]))), strict=True)]
            bounds = np.cumsum([len(x) for x in out[0]])[:-1]
            hashes = [np.split(span_hashes(s, base, flat, flat + span).view(np.int64), bounds) for base, s in sums]
            columns = [*map(_listed, out[1:]), _listed(out[0]), *map(_listed, hashes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "body", "f_start", "f_length", "f_ref", "f_at", "froms", "tos", "starts", "w1", "w2"])

    names = ["id", "body", "text", "at", "rid", "rbody", "rat", "many", "bid", "bbody", "bm", "words"]
    lists = ", ".join(f"{c} array<long>" for c in ("f_start", "f_length", "f_ref", "f_at", "froms", "tos", "starts", "w1", "w2"))
    return given.select(*names).mapInArrow(run, f"id long, body long, {lists}")


def parse(rows: DataFrame, span: int = SPAN, anchor: int = ANCHOR, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The parse of rows (id, body, text): (copies, parsed). copies: id, body, n, first of texts that a document of a smaller id has whole, one factor each;
    parsed: as parse_texts gives it, of all other texts with an anchor that stands elsewhere too.

    Each step's table goes to the shared folder and is deleted when the next is there. Aggregates are written before they are joined: a join right behind its
    exchanges is one whose hot keys Spark can split. An anchor names one reference place however many documents have it, so a document meets as many
    blocks as it has anchors at most.
    """
    anchors = cut(anchors_of(rows, span, anchor), "anchors")
    classes = cut(anchors.groupBy("name").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("name", "first"), "classes")
    copies = cut(anchors.select("id", "body", "name", "n").join(classes, "name").filter("id > first").select("id", "body", "n", "first"), "copies")
    once = anchors.join(classes, "name", "left").filter("first is null or id = first").dropDuplicates(["id", "body"])
    each = cut(once.select("id", "body", F.explode(F.arrays_zip("anchors", "places")).alias("a")).select("id", "body", F.col("a.anchors").alias("anchor"), F.col("a.places").alias("at")), "places")
    drop(anchors, classes)
    first = each.groupBy("anchor").agg(F.min(F.struct("id", "body", "at")).alias("r"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    index = cut(first.select("anchor", F.col("r.id").alias("rid"), F.col("r.body").alias("rbody"), F.col("r.at").alias("rat"), (F.col("c") > 2).alias("many")), "index")
    hits = cut(each.join(index, "anchor").filter("id > rid or many").select("id", "body", "at", "rid", "rbody", "rat", "many"), "hits")
    drop(each, index)

    ends = F.array_distinct(F.array(F.floor(F.greatest(F.col("rat") - (span - anchor), F.lit(0)) / block), F.floor(F.col("rat") / block)))
    needed = cut(hits.filter("id > rid").select("id", "body", "rid", "rbody", F.explode(ends).alias("m")).distinct(), "needed")
    wanted = needed.groupBy(F.col("rid").alias("id"), F.col("rbody").alias("body")).agg(F.collect_set("m").alias("wanted"))
    wanted = cut(wanted, "wanted")
    blocks = cut(reference_blocks(_of_texts(rows, wanted), span, block), "blocks")
    drop(wanted)
    named = blocks.select(F.col("id").alias("rid"), F.col("body").alias("rbody"), "m", "words")
    dealt = cut(needed.join(named, ["rid", "rbody", "m"]), "dealt")
    drop(needed, blocks)
    b = dealt.groupBy("id", "body").agg(F.collect_list(F.struct("rid", "rbody", "m", "words")).alias("b"))
    h = hits.groupBy("id", "body").agg(F.collect_list(F.struct("at", "rid", "rbody", "rat", "many")).alias("h")).join(b, ["id", "body"], "left")
    lists = h.select("id", "body", *(F.col(f"h.{c}").alias(c) for c in ("at", "rid", "rbody", "rat", "many")), F.col("b.rid").alias("bid"), F.col("b.rbody").alias("bbody"), F.col("b.m").alias("bm"), "b.words")
    lists = cut(lists, "lists")
    drop(hits, dealt)
    parsed = cut(parse_texts(_of_texts(rows, lists), span, anchor, block), "parsed")
    drop(lists)
    return copies, parsed


def duplicate_spans(rows: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """(id, body, spans): per text the word spans [start, end) that windows of documents with smaller ids cover. rows: id, body, text."""
    copies, parsed = parse(rows, span, anchor)
    windows = cut(parsed.select("id", "body", F.explode(F.arrays_zip("starts", "w1", "w2")).alias("w")).select("id", "body", F.col("w.starts").alias("start"), "w.w1", "w.w2"), "windows")
    first_of = cut(windows.groupBy("w1", "w2").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high").select("w1", "w2", "low"), "first")
    checked = windows.join(first_of, ["w1", "w2"]).filter("low < id").select("id", "body", "start", (F.col("start") + span).alias("end"))
    matched = parsed.select("id", "body", F.explode(F.arrays_zip("froms", "tos")).alias("m")).select("id", "body", F.col("m.froms").alias("start"), F.col("m.tos").alias("end"))
    whole = copies.select("id", "body", F.lit(0).cast("long").alias("start"), F.col("n").alias("end"))
    spans = cut(matched.union(checked).union(whole).groupBy("id", "body").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")), "spans")
    drop(copies, parsed, windows, first_of)
    return spans


def factor_documents(df: DataFrame, span: int = SPAN, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per factor: key, start, length (words), ref_key, ref_start: the greedy parse of each document against the documents with smaller keys.

    A document that an earlier one has whole is one factor. References are the first places of anchors, so factors shorter than span may be missed. Nulls,
    repeated rows and other columns as in digest_documents.
    """
    ship_package(df.sparkSession)
    rows = df.select(_ids(df, key).alias("id"), F.xxhash64(F.coalesce(df[text], F.lit(""))).alias("body"), F.coalesce(df[text], F.lit("")).alias("text"))
    copies, parsed = parse(rows, span, anchor)
    each = parsed.select("id", F.explode(F.arrays_zip("f_start", "f_length", "f_ref", "f_at")).alias("f")).select("id", "f.*")
    each = each.union(copies.select("id", F.lit(0).cast("long"), "n", "first", F.lit(0).cast("long")))
    back = lambda c, name: F.when(F.col(c) != NULL_ID, F.col(c)).alias(name)
    return each.select(back("id", key), F.col("f_start").alias("start"), F.col("f_length").alias("length"), back("f_ref", "ref_key"), F.col("f_at").alias("ref_start")).distinct()


def _covered(n: int, spans: list | None) -> np.ndarray:
    """Which of n words the spans cover."""
    marks = np.zeros(n + 1, np.int64)
    if spans:
        np.add.at(marks, [s["start"] for s in spans], 1)
        np.add.at(marks, [s["end"] for s in spans], -1)
    return np.cumsum(marks[:-1]) > 0


def _with_spans(df: DataFrame, key: str, text: str, span: int, anchor: int) -> DataFrame:
    """_row (all columns of df) with its spans."""
    marked = df.select(F.struct(*df.columns).alias("_row"), _ids(df, key).alias("_id"), F.xxhash64(F.coalesce(df[text], F.lit(""))).alias("_body"))
    spans = duplicate_spans(marked.select(F.col("_id").alias("id"), F.col("_body").alias("body"), F.coalesce(F.col("_row")[text], F.lit("")).alias("text")), span, anchor)
    spans = spans.select(F.col("id").alias("_sid"), F.col("body").alias("_sbody"), "spans")
    return marked.join(spans, (F.col("_id") == F.col("_sid")) & (F.col("_body") == F.col("_sbody")), "left").select("_row", "spans")


def remove_repeats(df: DataFrame, span: int = SPAN, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """df with repeated passages taken out of its texts: where words go, the others are joined by one space; other texts stay as they are.

    All rows and columns stay; a null text stays null. Rules for ids as in digest_documents.
    """
    ship_package(df.sparkSession)
    columns = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            new = []
            for t, spans in zip(texts, batch.column(1).to_pylist(), strict=True):
                if t is not None and spans:
                    words = t.encode().split()
                    t = b" ".join(w for w, gone in zip(words, _covered(len(words), spans), strict=True) if not gone).decode()
                new.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if n == text else batch.column(batch.schema.names.index(f"c_{n}")) for n in columns], columns)

    joined = _with_spans(df, key, text, span, anchor)
    row = F.col("_row")
    return joined.select(row[text].alias("_t"), F.col("spans").alias("_s"), *(row[c].alias(f"c_{c}") for c in columns if c != text)).mapInArrow(run, df.schema)


def digest_documents(df: DataFrame, span: int = SPAN, anchor: int = ANCHOR, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_removed, kept_sha256 of the kept words joined by one space.

    A word goes if a window of `span` words that covers it also starts in a document with a smaller key. A null text is empty; a null key is smaller than
    all others; rows that repeat a key do not count against each other; an empty table gives no rows; other columns are left out.
    """
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, removed, hashes = [], [], []
            for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (t or "").encode().split()
                gone = _covered(len(words), spans)
                n.append(len(words))
                removed.append(int(gone.sum()))
                kept = [w for w, g in zip(words, gone, strict=True) if not g] if spans else words
                hashes.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(hashes, pa.string())], [key, "n_words", "n_removed", "kept_sha256"])

    joined = _with_spans(df.select(key, text), key, text, span, anchor).select(f"_row.{key}", F.col("_row")[text].alias("_t"), "spans")
    return joined.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")

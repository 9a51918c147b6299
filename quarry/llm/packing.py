"""Best-fit packing by minimum bin slack.

Each bin begins with the longest piece left; a subset-sum over the lengths still available, as a bitset of reachable sums, finds the fullest
way to fill the rest, and that combination is removed. The work depends on how many pieces there are of each length,
not on the pieces, so the driver sees a histogram of at most `capacity` rows, and a combination is applied as often as the counts
allow. Pieces then find their places by their rank among pieces of their length.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quarry.llm.ranks import gapless_rank
from quarry.llm.words import slices
from quarry.session import cut, ship_package

CAPACITY = 4096
#: Words whose ids a task remembers; beyond it, it forgets all and starts again. Of them, a worker keeps so many for its next task.
REMEMBERED, KEPT = 400_000, 200_000
#: Text of these characters only is lower-cased and cut into words here as the tokenizer file says; other text goes to the tokenizer whole.
_OTHER = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xff]")
_WORDS = re.compile(r"[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]|'(?:s|t|re|ve|m|ll|d)|[^\s0-9a-zªµºß-öø-ÿ²³¹¼-¾]+")


class WordTokenizer:
    """Ids of texts by a tokenizers file that treats words one by one."""

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.added, self.folded = [t.content for t in added], [t.content.lower() for t in added if t.normalized]
        self.known: dict[str, bytes] = {}
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values(), default=0) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True

    def learn(self, words: list[str]) -> None:
        """Remember the ids of words. Many go to the tokenizer as one text; ids that end a word tell them apart."""
        encode = self.tokenizer.encode_batch_fast
        groups = [words[at : at + 256] for at in range(0, len(words), 256)]
        for group, e in zip(groups, encode([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(ends) == len(group):
                packed = ids.tobytes()
                self.known.update((w, packed[4 * a : 4 * b]) for w, a, b in zip(group, [0, *ends], ends, strict=False))
            else:
                self.known.update((w, np.array(x.ids, "<u4").tobytes()) for w, x in zip(group, encode(group, add_special_tokens=False), strict=True))

    def trim(self) -> None:
        """Keep the words that came first, as frequent ones do."""
        for word in list(islice(self.known, KEPT, None)):
            del self.known[word]

    def packed(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        # An added token in a text is one id, whatever stands around it: such texts go to the tokenizer whole.
        special = lambda t: any(a in t for a in self.added) or any(a in t.lower() for a in self.folded)
        cuts = [None if _OTHER.search(t) or special(t) else _WORDS.findall(t.lower()) for t in texts]
        known, missing = self.known, set()
        for words in cuts:
            missing.update(words or ())
        missing.difference_update(known)
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = {w for words in cuts for w in words or ()}
        self.learn(list(missing))
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(t) if words is None else b"".join(map(known.__getitem__, words)) for t, words in zip(texts, cuts, strict=True)]


_made: dict[str, WordTokenizer] = {}


def _tokenizer(definition: str) -> WordTokenizer:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = WordTokenizer(definition)
    return _made[key]


def cut_pieces(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, and with keep_ids its ids.

    A document's ids are its text's, then end_id; what is longer than capacity is cut into pieces of capacity, the last shorter.
    tokenizer: a tokenizers file; its content, whose size does not depend on the documents, is broadcast.
    """
    spark = df.sparkSession
    ship_package(spark)
    with open(tokenizer, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())
    last = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _tokenizer(definition.value)
        for batch, texts in slices(batches):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, packed in enumerate(encoder.packed([t.decode() for t in texts])):
                packed += last
                for n, at in enumerate(range(0, len(packed), 4 * capacity)):
                    part = packed[at : at + 4 * capacity]
                    row.append(i)
                    piece.append(n)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        ids.append(np.frombuffer(part, "<i4"))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        encoder.trim()

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, df[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


@dataclass(frozen=True)
class Combination:
    """lengths: (length, how many in a bin), the longest first; bins: how many such bins."""

    lengths: list[tuple[int, int]]
    bins: int


def fullest(room: int, lengths: list[int], counts: dict[int, int]) -> dict[int, int]:
    """The multiset of available lengths whose sum is the largest that room allows: subset-sum over a bitset."""
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in lengths:
        if length > room:
            continue
        left, times = min(counts[length], room // length), 1
        while left:
            take = min(times, left)
            grown = (reach | reach << (length * take)) & mask
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            left -= take
            times *= 2
        if reach >> room:
            break
    best, chosen = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> best & 1:
            chosen[length] = chosen.get(length, 0) + take
            best -= length * take
    return chosen


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[Combination]:
    """Combinations that hold all pieces of the histogram {length: count}; no length exceeds capacity."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        lengths = sorted((n for n, c in counts.items() if c), reverse=True)
        chosen = fullest(capacity - longest, lengths, counts)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        bins = min(counts[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            counts[n] -= k * bins
            if not counts[n]:
                del counts[n]
        out.append(Combination(sorted(chosen.items(), reverse=True), bins))
    return out


def places(combinations: list[Combination]) -> np.ndarray:
    """Rows (length, first rank, first sequence, pieces in a bin, offset of the first), sorted: where ranks of a length go.

    A combination uses up a length or nearly so, and holds at most about sqrt(2 * capacity) different lengths: the table's size depends
    on capacity alone, not on the pieces.
    """
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for c in combinations:
        offset = 0
        for length, k in c.lengths:
            rows.append((length, used.get(length, 0), sequence, k, offset))
            used[length] = used.get(length, 0) + k * c.bins
            offset += k * length
        sequence += c.bins
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack_pieces(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces, whose column length is 1 to capacity, with sequence_id and offset. pieces is read three times."""
    spark = pieces.sparkSession
    ship_package(spark)
    histogram = {int(r[0]): int(r[1]) for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}
    table = spark.sparkContext.broadcast(places(minimum_bin_slack(histogram, capacity)))
    ranked = gapless_rank(pieces, "length", order, "_rank", buckets=1024)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        begins = (rows[:, 0] << 40) + rows[:, 1]
        for batch in batches:
            names = batch.schema.names
            length, rank = (batch.column(names.index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "_rank"))
            found = rows[np.searchsorted(begins, (length << 40) + rank, "right") - 1]
            past = rank - found[:, 1]
            kept = [(n, batch.column(i)) for i, n in enumerate(names) if n != "_rank"]
            new = [("sequence_id", pa.array(found[:, 2] + past // found[:, 3])), ("offset", pa.array(found[:, 4] + past % found[:, 3] * length))]
            yield pa.RecordBatch.from_arrays([c for _, c in kept + new], [n for n, _ in kept + new])

    schema = StructType([*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(run, schema)


def pack_documents(df: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and gives one piece of the end id; equal rows give pieces of their own; an empty table gives none;
    other columns are left out. The pieces, without their ids, are written once to the shared folder.
    """
    pieces = cut(cut_pieces(df, tokenizer, end_id, capacity, key, text), "pieces")
    return pack_pieces(pieces, [key, "piece", "ids_crc32"], capacity)

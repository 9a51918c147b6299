"""Byte-level BPE encoding and decoding.

Two tiers. A minimal perfect hash over the vocabulary resolves a whole pre-token in one probe. A pre-token that is not in
the vocabulary is merged with a heap over linked bytes: the lowest rank first, the leftmost of equal ranks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from quarry.llm.words import slices
from quarry.session import ship_package

_M64 = 2**64 - 1
#: Pre-tokens whose ids a task remembers; beyond it, it forgets all and starts again.
REMEMBERED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with a line `base64 rank` for each token."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PerfectHash:
    """A minimal perfect hash of byte strings: n keys, n slots, one probe.

    Keys fall into buckets by their hash; a bucket has a displacement under which its keys get free slots, the largest
    buckets first. A bucket of one key gets a free slot directly.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // 3)
        groups: dict[int, list[tuple[int, int]]] = {}
        for i, key in enumerate(keys):
            h = xxhash.xxh64_intdigest(key)
            groups.setdefault(h % self.buckets, []).append((h, i))
        self.shift = [0] * self.buckets
        self.at = [-1] * self.n
        single = []
        for bucket, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                single.append((bucket, members[0][1]))
                continue
            shift = 0
            while True:
                slots = [self._slot(h, shift) for h, _ in members]
                if len(set(slots)) == len(slots) and all(self.at[s] < 0 for s in slots):
                    break
                shift += 1
            self.shift[bucket] = shift
            for s, (_, i) in zip(slots, members, strict=True):
                self.at[s] = i
        free = (s for s, i in enumerate(self.at) if i < 0)
        for bucket, i in single:
            s = next(free)
            self.shift[bucket] = -s - 1
            self.at[s] = i
        self.keys = [keys[i] for i in self.at]

    def _slot(self, h: int, shift: int) -> int:
        return ((((h ^ (shift * 0x9E3779B97F4A7C15)) & _M64) * 0xD6E8FEB86659FD93 & _M64) >> 32) % self.n

    def find(self, key: bytes) -> int:
        """The number of the key as it was given, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        shift = self.shift[h % self.buckets]
        slot = -shift - 1 if shift < 0 else self._slot(h, shift)
        return self.at[slot] if self.keys[slot] == key else -1


class Bpe:
    """Encoder and decoder of one vocabulary. ranks: token bytes to id, a lower id merges first."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        tokens = list(ranks)
        self.whole = PerfectHash(tokens)
        self.ids = [ranks[t] for t in tokens]
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.known: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token by merges: a heap of pairs over linked parts."""
        ranks, n = self.ranks, len(word)
        parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(word[i : i + 2])
            if rank is not None:
                heap.append((rank, i, word[i : i + 2]))
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            left = parts[i]
            j = after[i]
            if left is None or j >= n or left + parts[j] != joined:
                continue
            parts[i], parts[j] = joined, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                pair = joined + parts[k]
                rank = ranks.get(pair)
                if rank is not None:
                    heapq.heappush(heap, (rank, i, pair))
            h = before[i]
            if h >= 0:
                pair = parts[h] + joined
                rank = ranks.get(pair)
                if rank is not None:
                    heapq.heappush(heap, (rank, h, pair))
        return [ranks[p] for p in parts if p is not None]

    def resolve(self, token: str) -> bytes:
        """Ids of one pre-token as little-endian 32-bit integers: by the perfect hash, else by merges."""
        key = token.encode()
        found = self.whole.find(key)
        ids = [self.ids[found]] if found >= 0 else self.merge(key)
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def encode_packed(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        known, tokens = self.known, self.split(text)
        missing = set(tokens).difference(known)
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = set(tokens)
        for token in missing:
            known[token] = self.resolve(token)
        return b"".join(map(known.__getitem__, tokens))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_made: dict[str, Bpe] = {}


def _bpe(table: bytes, pattern: str) -> Bpe:
    """The encoder of this Python worker, made once for each vocabulary."""
    key = hashlib.sha256(table + pattern.encode()).hexdigest()
    if key not in _made:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in table.splitlines() if line.strip())}
        _made.clear()
        _made[key] = Bpe(ranks, pattern)
    return _made[key]


def encode_documents(df: DataFrame, vocabulary: str, pattern: str, key: str = "doc_id", text: str = "text", keep_ids: bool = True) -> DataFrame:
    """Per row: key, n_tokens, ids_sha256, decoded_sha256, and with keep_ids the ids themselves.

    vocabulary: a file of ranks; its content, whose size does not depend on the documents, is broadcast.
    A null text counts as empty and has no ids; equal rows give equal rows; an empty table gives none; other columns are
    left out. Texts of any length are encoded whole.
    """
    spark = df.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as f:
        table = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(table.value, pattern)
        for batch, texts in slices(batches):
            ids, counts, hashes, decoded = [], [], [], []
            for t in texts:
                packed = bpe.encode_packed(t.decode())
                numbers = np.frombuffer(packed, "<u4")
                counts.append(len(numbers))
                hashes.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(numbers.tolist())).hexdigest())
                if keep_ids:
                    ids.append(numbers.astype(np.int32))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        bpe.known.clear()

    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return df.select(key, df[text].alias("text")).mapInArrow(run, schema)


def decode_documents(df: DataFrame, vocabulary: str, ids: str = "ids", key: str = "doc_id") -> DataFrame:
    """Per row: key and the decoded bytes of its ids. Null ids give empty bytes."""
    spark = df.sparkSession
    ship_package(spark)
    with open(vocabulary, "rb") as f:
        table = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(table.value, r"[\s\S]+")
        for batch in batches:
            decoded = [bpe.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(decoded, pa.binary())], [key, "bytes"])

    return df.select(key, df[ids].alias("ids")).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, bytes binary")

"""Token counts by linear longest match.

The vocabulary is a trie with failure links. A node's failure link leads to where the greedy match stands after the tokens that are
certain by then have been popped, and the node keeps only how many those are. Walking a word once so gives the number of its
greedy pieces, without building a piece.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.bpe import read_ranks
from quarry.llm.words import slices
from quarry.session import ship_package

#: Words whose counts a task remembers; beyond it, it forgets all and starts again.
REMEMBERED = 500_000


class LongestMatch:
    """Counts of greedy longest-match pieces. A word that cannot be cut into tokens counts as one."""

    def __init__(self, tokens: Iterable[bytes]):
        self.edge: dict[int, int] = {}
        self.fail, self.pops, token_at, depth_of = [-1], [0], [False], [0]
        made: list[tuple[int, int, int]] = []
        for token in tokens:
            node = 0
            for byte in token:
                child = self.edge.get(node << 8 | byte)
                if child is None:
                    child = len(self.fail)
                    self.edge[node << 8 | byte] = child
                    self.fail.append(-1)
                    self.pops.append(0)
                    token_at.append(False)
                    depth_of.append(depth_of[node] + 1)
                    made.append((child, node, byte))
                node = child
            token_at[node] = node > 0
        for node, parent, byte in sorted(made, key=lambda m: depth_of[m[0]]):
            if token_at[node]:
                self.fail[node], self.pops[node] = 0, 1
                continue
            at, popped = self.fail[parent], self.pops[parent]
            while at >= 0 and (at << 8 | byte) not in self.edge:
                popped += self.pops[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.pops[node] = self.edge[at << 8 | byte], popped
        self.known: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """How many pieces the greedy match cuts word into."""
        edge, fail, pops = self.edge, self.fail, self.pops
        node = total = 0
        for byte in word:
            child = edge.get(node << 8 | byte)
            while child is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
                child = edge.get(node << 8 | byte)
            node = child
        while node:
            total += pops[node]
            node = fail[node]
            if node < 0:
                return 1
        return total

    def count_text(self, text: bytes, prefix: bytes) -> tuple[int, int]:
        """Words of a text, and the pieces of all of them; prefix stands before each word."""
        known, words = self.known, text.split()
        missing = set(words).difference(known)
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = set(words)
        for word in missing:
            known[word] = self.count(prefix + word)
        return len(words), sum(map(known.__getitem__, words))


_made: dict[str, LongestMatch] = {}


def _matcher(tokens: list[bytes]) -> LongestMatch:
    key = hashlib.sha256(b"\0".join(tokens)).hexdigest()
    if key not in _made:
        _made.clear()
        _made[key] = LongestMatch(tokens)
    return _made[key]


def count_tokens(df: DataFrame, vocabulary: str, prefix: bytes = b" ", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_tokens: greedy pieces of all words of the text, each with prefix before it.

    vocabulary: a file of ranks, whose tokens begin with the prefix where they begin a word; its tokens, whose size does not depend on the
    documents, are broadcast. A null or empty text has 0 of both; equal rows give equal rows; an empty table gives none; other
    columns are left out.
    """
    spark = df.sparkSession
    ship_package(spark)
    tokens = spark.sparkContext.broadcast(list(read_ranks(vocabulary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(tokens.value)
        for batch, texts in slices(batches):
            counted = [matcher.count_text(t, prefix) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([c[0] for c in counted], pa.int64()), pa.array([c[1] for c in counted], pa.int64())], [key, "n_words", "n_tokens"]
            )
        matcher.known.clear()

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, df[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, n_words long, n_tokens long")

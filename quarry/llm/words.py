"""Words and their hashes over whole Arrow batches, without a Python object for each word.

Words are runs of bytes other than space and 0x09-0x0D. A hash is a polynomial modulo 2**64 over random
values of the bytes, finished by a mixer; equal words have equal hashes on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER_VALUES = BYTE_VALUES.copy()
LOWER_VALUES[65:91] = BYTE_VALUES[97:123]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BLOCK = 1 << 19
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1024), base % 2**64, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the result."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Batch:
    """Texts of a batch as one byte array, with the place and document of every word.

    data: all bytes; offsets: where each text begins, and the end; starts, ends: of words, in data;
    doc_of: the text of each word; word_from: the first word of each text, and the number of words.
    """

    def __init__(self, texts: list[bytes], gaps: np.ndarray = _SPACE):
        """gaps: which of the 256 bytes stand between words."""
        self.n = len(texts)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.zeros(self.n + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=self.offsets[1:])
        size = len(self.data)
        self.is_word = ~gaps[self.data]
        begins = self.is_word.copy()
        begins[1:] &= ~self.is_word[:-1]
        edges = self.offsets[:-1][np.diff(self.offsets) > 0]
        begins[edges] = self.is_word[edges]
        finishes = self.is_word.copy()
        finishes[:-1] &= ~self.is_word[1:]
        lasts = self.offsets[1:][np.diff(self.offsets) > 0] - 1
        finishes[lasts] = self.is_word[lasts]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        self.word_from = np.searchsorted(self.starts, self.offsets)
        self.n_words = np.diff(self.word_from)
        self.doc_of = np.repeat(np.arange(self.n), self.n_words)
        assert size == self.offsets[-1]

    def hashes(self, values: np.ndarray = BYTE_VALUES, most: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first `most` bytes, worked out in blocks of a few MB."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            first = int(self.starts[at])
            upto = max(at + 1, int(np.searchsorted(self.ends, first + _BLOCK, "right")))
            last = int(self.ends[upto - 1])
            sums = np.empty(last - first + 1, np.uint64)
            sums[0] = 0
            np.cumsum(values[self.data[first:last]] * powers(_BASE, last - first), out=sums[1:])
            begin, end = self.starts[at:upto] - first, self.ends[at:upto] - first
            end = end if most is None else np.minimum(end, begin + most)
            out[at:upto] = mix((sums[end] - sums[begin]) * powers(_INVERSE, last - first)[begin] + (end - begin).astype(np.uint64))
            at = upto
        return out

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first words of all windows of k words in one text, and the text of each."""
        if len(self.starts) < k:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        first = np.flatnonzero(self.doc_of[k - 1 :] == self.doc_of[: len(self.doc_of) - k + 1])
        return first, self.doc_of[first]


_SHINGLE = [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3]


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the windows of k words that begin at first."""
    total = np.zeros(len(first), np.uint64)
    for j in range(k):
        total += words[first + j] * U64((_SHINGLE[j % 5] + 2 * (j // 5)) % 2**64)
    return mix(total)


def span_sums(words: np.ndarray, base: int) -> np.ndarray:
    """Running polynomial sums, from which span_hashes gets the hash of any span of words."""
    sums = np.empty(len(words) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(words * powers(base, len(words)), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, base: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans of words [first, end)."""
    inverse = powers(pow(base, -1, 2**64), len(sums))
    return mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [t or b"" for t in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 1 << 21) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut batches so that a slice has about limit bytes of text, or one text."""
    for batch in batches:
        texts = texts_of(batch, column)
        at, size = 0, 0
        for i, text in enumerate(texts):
            if i > at and size + len(text) > limit:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(text)
        if at < len(texts):
            yield batch.slice(at), texts[at:]


def per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many elements of mask are true between each two offsets."""
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return np.diff(sums[offsets])

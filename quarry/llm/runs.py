"""Periodic runs of words: stretches that repeat a block of words four times or more, found by probing a grid for each period.

A run of period p in which the block stands four times holds three places in a row of the grid p, 2p, 3p, ... whose words equal those p later. So each period asks only
n / p pairs of words, n log n for all; what survives is extended both ways by comparing chunks that double in size, and grid places inside a
stretch that was already compared, or inside a run of a period that divides p, are skipped.
"""

from __future__ import annotations

import bisect
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.words import Batch, slices
from quarry.session import ship_package

LEAST_WORDS, LEAST_PERIODS = 6, 4
_CHUNK = 16


def _matches_after(words: np.ndarray, at: int, p: int) -> int:
    """The end of the stretch from at on in which words equal those p later."""
    size, end = _CHUNK, len(words) - p
    while at < end:
        upto = min(at + size, end)
        differ = words[at:upto] != words[at + p : upto + p]
        first = int(differ.argmax())
        if differ[first]:
            return at + first
        at, size = upto, 2 * size
    return end


def _matches_before(words: np.ndarray, at: int, p: int) -> int:
    """The beginning of the stretch up to at in which words equal those p later."""
    size = _CHUNK
    while at > 0:
        begin = max(0, at - size)
        differ = (words[begin:at] != words[begin + p : at + p])[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return at - first
        at, size = begin, 2 * size
    return 0


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; words: a value for each word, equal for equal words.

    A run has the period q as its smallest, a length of max(6, 4q) at least, and no neighbouring word that goes on with q.
    """
    runs: list[tuple[int, int, int]] = []
    by_length: list[tuple[int, int, int]] = []  # (-length, start, period)
    n = len(words)
    for p in range(1, n // LEAST_PERIODS + 1):
        grid = words[::p]
        same = grid[1:] == grid[:-1]
        if not same.any():
            continue
        probes = np.flatnonzero(same[:-2] & same[1:-1] & same[2:]) * p
        # A stretch whose smallest period q is less than p was found as a run of q, which divides p: all its places go.
        for less, start, q in by_length:
            if not len(probes) or -less <= (LEAST_PERIODS - 1) * p:
                break
            if p % q == 0:
                inside = np.searchsorted(probes, [start, start - less - p])
                if inside[0] < inside[1]:
                    probes = np.delete(probes, slice(*inside))
        at = 0
        while at < len(probes):
            begin = _matches_before(words, int(probes[at]), p)
            end = _matches_after(words, int(probes[at]), p)
            length = end - begin + p
            if length >= max(LEAST_WORDS, LEAST_PERIODS * p):
                runs.append((begin, length, p))
                bisect.insort(by_length, (-length, begin, p))
            at = int(np.searchsorted(probes, end))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def repeats_of(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stand in a run behind its first period."""
    steps = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) > 0


def longest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length; of equal ones the smallest start, then period."""
    return min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)


def periodic_tail(key: int | None, n: int) -> np.ndarray | None:
    """For a tenth of the keys, which of n words stands at each place once the text's tail repeats a block; None where nothing changes (a null key too)."""
    h = zlib.crc32(str(key).encode())
    if key is None or n == 0 or h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _texts_with_runs(df: DataFrame, key: str, text: str, arrange: Callable[[int | None, int], np.ndarray | None] | None, schema: str, arrays: Callable) -> DataFrame:
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            keys, b, rows = batch.column(0).to_pylist(), Batch(texts), []
            hashes = b.hashes()
            for i, text in enumerate(texts):
                own = hashes[b.word_from[i] : b.word_from[i + 1]]
                places = arrange(keys[i], len(own)) if arrange else None
                own = own if places is None else own[places]
                runs = find_runs(own)
                words = None
                if runs or places is not None:
                    first = int(b.offsets[i])
                    words = [text[s - first : e - first] for s, e in zip(b.starts[b.word_from[i] : b.word_from[i + 1]].tolist(), b.ends[b.word_from[i] : b.word_from[i + 1]].tolist(), strict=True)]
                    words = words if places is None else [words[j] for j in places.tolist()]
                rows.append((runs, words if words is not None else text.split(), len(own)))
            yield arrays(batch.column(0), rows)

    return df.select(df[key].alias(key), df[text].alias("text")).mapInArrow(run, schema)


def runs_of_documents(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, period), a row for each run of each row of df; null and empty texts have none, equal rows each their own."""

    def arrays(keys: pa.Array, rows: list) -> pa.RecordBatch:
        take = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
        flat = np.array([x for r in rows for x in r[0]], np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([keys.take(pa.array(take)), *(pa.array(np.ascontiguousarray(c)) for c in flat.T)], [key, "start", "length", "period"])

    kind = df.schema[key].dataType.simpleString()
    return _texts_with_runs(df, key, text, None, f"`{key}` {kind}, start long, length long, period long", arrays)


def _collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    return b" ".join(w for w, g in zip(words, repeats_of(len(words), runs).tolist(), strict=True) if not g) if runs else b" ".join(words)


def collapse_runs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): the words of each text joined by one space, each run cut down to its first period. Null and empty texts become empty."""

    def arrays(keys: pa.Array, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([keys, pa.array([_collapsed(words, runs).decode() for runs, words, _ in rows], pa.string())], [key, "text"])

    kind = df.schema[key].dataType.simpleString()
    return _texts_with_runs(df, key, text, None, f"`{key}` {kind}, text string", arrays)


def digest_runs(df: DataFrame, key: str = "doc_id", text: str = "text", arrange: Callable[[int | None, int], np.ndarray | None] | None = None) -> DataFrame:
    """Per row: key, n_runs, the longest run (start, length, period, exponent_milli; null without one), and hashes of all runs and of the text without their repeats.

    arrange: from a key and a number of words, the places that the words are taken from, or None. A null or empty text has no runs; equal rows give equal
    rows; very long texts are compared whole; an empty table gives none; other columns are left out.
    """

    def arrays(keys: pa.Array, rows: list) -> pa.RecordBatch:
        best = [longest(runs) for runs, _, _ in rows]
        longs = lambda values: pa.array(values, pa.int64())
        told = ["".join(f"{s},{n},{p}\n" for s, n, p in runs).encode() for runs, _, _ in rows]
        return pa.RecordBatch.from_arrays(
            [
                keys,
                longs([len(runs) for runs, _, _ in rows]),
                *(longs([b and b[c] for b in best]) for c in range(3)),
                longs([b and 1000 * b[1] // b[2] for b in best]),
                pa.array([hashlib.sha256(x).hexdigest() for x in told]),
                pa.array([hashlib.sha256(_collapsed(words, runs)).hexdigest() for runs, words, _ in rows]),
            ],
            [key, *COLUMNS],
        )

    kind = df.schema[key].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in COLUMNS[:5])
    return _texts_with_runs(df, key, text, arrange, f"`{key}` {kind}, {longs}, runs_sha256 string, collapsed_sha256 string", arrays)


COLUMNS = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]

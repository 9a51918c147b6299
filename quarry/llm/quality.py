"""Quality rules as a short-circuit cascade.

Each rule's cost and rejection are estimated on a bounded random sample of all rows, after the rules before it: on the documents that they leave, and
without the cost of features that they have worked out. The rule of the highest rejection per cost comes next. A document that one rule
rejects is not shown to the next. The verdict is the conjunction of all rules, so it does not depend on the order; the order decides only how
much work is done.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.words import U64, Batch, mix, per_text, shingle_hashes, slices
from quarry.session import ship_package

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(0x21, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


class Features:
    """Counts of some texts, each worked out when first asked for."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self._have: dict[str, np.ndarray] = {}
        self._batch: Batch | None = None

    def fork(self) -> Features:
        """The same texts with what is known about them; what the copy works out stays with it."""
        own = Features(self.texts)
        own._have, own._batch = dict(self._have), self._batch
        return own

    def without(self, gone: np.ndarray) -> Features:
        """The texts that are not gone, with their known counts. Words are cut anew for what is asked for later."""
        if not gone.any():
            return self
        own = Features([t for t, g in zip(self.texts, gone, strict=True) if not g])
        own._have = {name: values[~gone] for name, values in self._have.items()}
        return own

    @property
    def batch(self) -> Batch:
        if self._batch is None:
            self._batch = Batch(self.texts)
        return self._batch

    def _once(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self._have:
            self._have[name] = make()
        return self._have[name]

    @property
    def n_words(self) -> np.ndarray:
        return self._once("n_words", lambda: self.batch.n_words)

    @property
    def word_chars(self) -> np.ndarray:
        """Code points in words: their bytes that do not continue a character."""
        return self._once("word_chars", lambda: per_text(self.batch.is_word & ((self.batch.data & 0xC0) != 0x80), self.batch.offsets))

    @property
    def n_symbols(self) -> np.ndarray:
        return self._once("n_symbols", lambda: per_text(_SYMBOL[self.batch.data], self.batch.offsets))

    @property
    def n_marks(self) -> np.ndarray:
        """ASCII digits and punctuation."""
        return self._once("n_marks", lambda: per_text(_MARK[self.batch.data], self.batch.offsets))

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        if "n_lines" not in self._have:
            lines, again = [], []
            for text in self.texts:
                own = [x for x in text.split(b"\n") if x.strip()]
                lines.append(len(own))
                again.append(len(own) - len(set(own)))
            self._have["n_lines"], self._have["n_dup_lines"] = np.array(lines, np.int64), np.array(again, np.int64)
        return self._have["n_lines"], self._have["n_dup_lines"]

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines()[0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines()[1]

    def _repeats(self) -> np.ndarray:
        b = self.batch
        first, doc = b.windows(3)
        flagged = np.zeros(len(b.starts), bool)
        if len(first):
            keys = mix(shingle_hashes(b.hashes(), first, 3) ^ mix(doc.astype(np.uint64) + U64(1)))
            order = np.argsort(keys)
            sorted_keys = keys[order]
            same = sorted_keys[1:] == sorted_keys[:-1]
            twice = np.zeros(len(keys), bool)
            twice[1:] |= same
            twice[:-1] |= same
            again = first[order[twice]]
            for j in range(3):
                flagged[again + j] = True
        return per_text(flagged, b.word_from)

    @property
    def n_repeat_words(self) -> np.ndarray:
        """Words in windows of 3 words that the text has twice or more."""
        return self._once("n_repeat_words", self._repeats)


@dataclass(frozen=True)
class Rule:
    """rejects: the texts of a batch that fail, from its features."""

    name: str
    rejects: Callable[[Features], np.ndarray]


#: The base rules come first; the others reject text that is mostly symbols, digits or punctuation, has no real words or repeats its lines.
RULES = [
    Rule("few_words", lambda f: f.n_words < 50),
    Rule("repeated_words", lambda f: 100 * f.n_repeat_words > 50 * f.n_words),
    Rule("symbols", lambda f: 3 * f.n_symbols > f.n_words),
    Rule("word_length", lambda f: (f.word_chars < 2 * f.n_words) | (f.word_chars > 20 * f.n_words)),
    Rule("repeated_lines", lambda f: (2 * f.n_dup_lines > f.n_lines) & (f.n_lines >= 4)),
    Rule("marks", lambda f: 2 * f.n_marks > f.word_chars),
]
#: The same without a least length: short clean documents stay, those without a word go.
ANY_LENGTH = [Rule("no_words", lambda f: f.n_words < 1), *RULES[1:]]
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def sampled(df: DataFrame, text: str, sample: int) -> list[bytes]:
    """About `sample` texts, drawn row by row with one chance from the whole table; all texts of a table of fewer."""
    rows = df.select(df[text])
    n = rows.count()
    drawn = rows if n <= sample else rows.sample(fraction=sample / n, seed=11)
    return [(r[0] or "").encode() for r in drawn.collect()]


def estimate(texts: list[bytes], rules: list[Rule], clock: Callable[[], float] = time.perf_counter) -> list[tuple[str, float, float]]:
    """(name, seconds a document, share rejected) of the rules in the order in which they should run: each measured on the sample's documents that the rules
    before it leave, with the features that those have worked out at hand. Rules that see no documents come last, in their own order."""
    out, left, features = [], list(rules), Features(texts)
    while left and features.texts:
        measured = []
        for rule in left:
            own = features.fork()
            began = clock()
            gone = rule.rejects(own)
            measured.append(((clock() - began) / len(features.texts), gone, own))
        best = max(range(len(left)), key=lambda i: measured[i][1].mean() / max(measured[i][0], 1e-9))
        cost, gone, own = measured[best]
        out.append((left.pop(best).name, cost, float(gone.mean())))
        features = own.without(gone)
    return out


def cascade_order(rules: list[Rule], measured: list[tuple[str, float, float]]) -> list[Rule]:
    """The rules in the order of estimate; unmeasured rules last, in their own order."""
    place = {name: i for i, (name, _, _) in enumerate(measured)}
    return sorted(rules, key=lambda r: place.get(r.name, len(place)))


def run_cascade(texts: list[bytes], rules: list[Rule], features: Features | None = None) -> np.ndarray:
    """Which texts pass all rules; each rule sees only what the rules before it left."""
    alive = np.arange(len(texts))
    features = Features(texts) if features is None else features
    for rule in rules:
        if not len(alive):
            break
        gone = rule.rejects(features)
        alive = alive[~gone]
        features = features.without(gone)
    kept = np.zeros(len(texts), bool)
    kept[alive] = True
    return kept


def filter_documents(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample: int = 256) -> DataFrame:
    """The rows of df that pass all rules, with all their columns. Null texts count as empty, and fail `few_words` or `no_words`; equal texts fare alike; an
    empty table gives none."""
    rules = list(RULES if rules is None else rules)
    ordered = cascade_order(rules, estimate(sampled(df, text, sample), rules))
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text):
            yield batch.filter(pa.array(run_cascade(texts, ordered)))

    return df.mapInArrow(run, df.schema)


def score_documents(df: DataFrame, rules: list[Rule] | None = None, key: str = "doc_id", text: str = "text", sample: int = 256) -> DataFrame:
    """Per row: key, the five counts, base_failed and kept (false if base_failed, else the cascade's verdict).

    A null or empty text has no words and fails the base; equal rows give equal rows; an empty table gives none; other columns
    are left out. The five counts are there for every row; what rules ask for beyond them is worked out only for texts that the base and the rules before
    leave.
    """
    rules = list(RULES if rules is None else rules)
    ordered = cascade_order(rules, estimate(sampled(df, text, sample), rules))
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            f = Features(texts)
            counts = [getattr(f, name) for name in COUNTS]
            failed = (f.n_words < 50) | (100 * f.n_repeat_words > 50 * f.n_words)
            verdict = np.zeros(len(texts), bool)
            verdict[~failed] = run_cascade([t for t, x in zip(texts, failed, strict=True) if not x], ordered, f.without(failed))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(verdict)],
                [key, *COUNTS, "base_failed", "kept"],
            )

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, df[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean")

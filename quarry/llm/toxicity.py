"""Toxicity by non-negative positive-unlabelled learning.

Linear classifiers over hashed word beginnings and words learn from texts that are confirmed toxic and from unlabelled ones, which hold toxic texts as well, in the share of the
class prior. The risk of calling clean texts toxic is that of the unlabelled texts less the prior's share of the toxic ones; where a batch's estimate
falls below zero, which no true risk does, its step goes back (Kiryo, Niu, du Plessis and Sugiyama 2017). The same correction chooses the features and the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.words import LOWER_VALUES, U64, Batch, mix, slices
from quarry.session import ship_package

#: Hash bins of features; a model is a weight for each, 1 MB.
BITS = 18
#: Bytes of a word's beginnings; the whole word is a feature too.
PREFIXES = (3, 4, 5, 6, 7, 8)
#: Texts that are fitted on, about so many at most of each kind, and features of one of them at most; scores are of whole texts and all their features.
POSITIVES, UNLABELLED, FEATURES = 2000, 6000, 8192
#: Features kept by a classifier; ROUNDS times FOLDS classifiers, each fitted without one part of the texts, whose margins then place the threshold.
SELECTED, FOLDS, ROUNDS = 4000, 4, 3
#: Toxic texts that a feature must be in.
LEAST = 3
EPOCHS, BATCHES, STEP, SHRINK = 60, 8, 0.03, 1e-4
#: The score at the threshold.
CALLED = 0.7

_GAPS = np.ones(256, bool)
_GAPS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_PLACES = 1 << 31


@dataclass
class Sparse:
    """Feature counts of n texts, by text: rows, bins, counts; words: of each text."""

    n: int
    rows: np.ndarray
    bins: np.ndarray
    counts: np.ndarray
    words: np.ndarray

    def part(self, chosen: np.ndarray) -> Sparse:
        """The texts of a mask."""
        place = np.cumsum(chosen) - 1
        own = chosen[self.rows]
        return Sparse(int(chosen.sum()), place[self.rows[own]], self.bins[own], self.counts[own], self.words[chosen])

    def only(self, place: np.ndarray) -> Sparse:
        """The bins that place does not set to -1, renumbered."""
        bins = place[self.bins]
        own = bins >= 0
        return Sparse(self.n, self.rows[own], bins[own], self.counts[own], self.words)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Of each text, the weights of its bins times the logarithms of their counts."""
        return np.bincount(self.rows, weights[self.bins] * np.log1p(self.counts), self.n)


def lengths(words: np.ndarray) -> np.ndarray:
    """The logarithm of a text's words beyond about fifty; short and empty texts have none."""
    return np.maximum(np.log1p(words) - 4, 0)


def features(texts: list[bytes], wanted: np.ndarray | None = None) -> Sparse:
    """Feature counts of texts, of all bins or those that wanted marks."""
    b = Batch(texts, _GAPS)
    size = b.ends - b.starts
    keys = []
    for most in (*PREFIXES, None):
        longer = slice(None) if most is None else size > most
        bins = (mix(b.hashes(LOWER_VALUES, most)[longer] + U64(most or 0)) >> U64(64 - BITS)).astype(np.int64)
        docs = b.doc_of[longer]
        if wanted is not None:
            own = wanted[bins]
            bins, docs = bins[own], docs[own]
        keys.append(docs << BITS | bins)
    key, counts = np.unique(np.concatenate(keys), return_counts=True)
    return Sparse(len(texts), key >> BITS, key & ((1 << BITS) - 1), counts, b.n_words)


@dataclass
class Model:
    """Weights by bin, of the length and the constant, less the threshold. Without a confirmed text all scores are 0."""

    weights: np.ndarray
    length: float = 0.0
    constant: float = 0.0
    fitted: bool = True

    def margins(self, x: Sparse) -> np.ndarray:
        """How far texts are beyond the threshold."""
        return x.sums(self.weights) + self.length * lengths(x.words) + self.constant

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.fitted:
            return np.zeros(len(texts))
        beyond = self.margins(features(texts, self.weights != 0)) + np.log(CALLED / (1 - CALLED))
        return np.exp(-np.logaddexp(0, -beyond))


def select(positive: Sparse, unlabelled: Sparse, prior: float) -> np.ndarray:
    """Bins that toxic texts have more often than clean ones, the most telling; a clean text's share is what the prior leaves of the unlabelled ones."""
    found = np.bincount(positive.bins, minlength=1 << BITS)
    toxic = found / positive.n
    clean = np.maximum((np.bincount(unlabelled.bins, minlength=1 << BITS) / unlabelled.n - prior * toxic) / (1 - prior), 0)
    least = 0.5 / min(positive.n, unlabelled.n)
    told = toxic * np.log((toxic + least) / (clean + least)) - (toxic - clean)
    told[(found < min(LEAST, positive.n)) | (toxic <= clean)] = 0
    best = np.argsort(-told, kind="stable")[:SELECTED]
    return best[told[best] > 0]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def descend(positive: Sparse, unlabelled: Sparse, prior: float, n: int, seed: int) -> np.ndarray:
    """Weights of n bins, the length and the constant that make the non-negative risk small, by Adam's steps over batches."""
    rng = np.random.default_rng(seed)
    deal = [rng.permutation(x.n) % BATCHES for x in (positive, unlabelled)]
    batches = [(positive.part(deal[0] == k), unlabelled.part(deal[1] == k)) for k in range(BATCHES)]
    # Features, then length and constant, as one sparse row for each text.
    rows = [[(x, np.log1p(x.counts), lengths(x.words)) for x in both] for both in batches if both[0].n and both[1].n]
    w, mean, square = np.zeros(n + 2), np.zeros(n + 2), np.zeros(n + 2)
    w[-1], t = -2.0, 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(rows)):
            z = [np.bincount(x.rows, w[x.bins] * v, x.n) + w[-2] * length + w[-1] for x, v, length in rows[k]]
            risk = np.logaddexp(0, z[1]).mean() - prior * np.logaddexp(0, z[0]).mean()
            if risk >= 0:
                slopes = [prior * (-_sigmoid(-z[0]) - _sigmoid(z[0])) / len(z[0]), _sigmoid(z[1]) / len(z[1])]
            else:
                slopes = [prior * _sigmoid(z[0]) / len(z[0]), -_sigmoid(z[1]) / len(z[1])]
            g = np.zeros(n + 2)
            for (x, v, length), s in zip(rows[k], slopes, strict=True):
                g[:n] += np.bincount(x.bins, s[x.rows] * v, n)
                g[-2:] += s @ length, s.sum()
            g[:-1] += SHRINK * w[:-1]
            t += 1
            mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
            w -= STEP * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-8)
    return w


def threshold(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> float:
    """Where the corrected error is least: the prior's share of toxic margins below, and what unlabelled ones above leave once the toxic ones above are taken off."""
    steps = np.unique(positive)
    cuts = np.concatenate([[steps[0] - 1e-3], (steps[1:] + steps[:-1]) / 2])
    missed = np.searchsorted(np.sort(positive), cuts) / len(positive)
    above = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    error = prior * missed + np.maximum(0, above - prior * (1 - missed))
    best = np.sort(cuts[error <= error.min() + 1 / len(unlabelled)])  # as good as can be told from so many texts
    return float(best[len(best) // 2])


def fit(positive: Sparse, unlabelled: Sparse, prior: float, seed: int = 13) -> Model:
    """The mean of all classifiers; each scores the texts that it was not fitted on, and these margins place the threshold."""
    model = Model(np.zeros(1 << BITS), fitted=positive.n > 0 and unlabelled.n > 0)
    if not model.fitted:
        return model
    rng = np.random.default_rng(seed)
    both = positive, unlabelled
    margins = [np.zeros(x.n) for x in both]
    for each in range(ROUNDS):
        folds = [rng.permutation(x.n) % FOLDS for x in both]
        for k in range(FOLDS):
            own = [x.part(fold != k) for x, fold in zip(both, folds, strict=True)]
            own = own if own[0].n and own[1].n else list(both)  # a single text is in all folds
            best = select(*own, prior)
            place = np.full(1 << BITS, -1)
            place[best] = np.arange(len(best))
            w = descend(*(x.only(place) for x in own), prior, len(best), each * FOLDS + k)
            one = Model(np.zeros(1 << BITS), w[-2], w[-1])
            one.weights[best] = w[:-2]
            for x, fold, m in zip(both, folds, margins, strict=True):
                m[fold == k] += one.margins(x.part(fold == k)) / ROUNDS
            model.weights += one.weights / (FOLDS * ROUNDS)
            model.length += one.length / (FOLDS * ROUNDS)
            model.constant += one.constant / (FOLDS * ROUNDS)
    model.constant -= threshold(*margins, prior)
    return model


def held_out(key: Column) -> Column:
    """Whether a row's label is never learnt from; a null key has none."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def _chance(share: float, key: str) -> Column:
    """A fixed draw by key."""
    return F.pmod(F.xxhash64(F.lit("toxicity"), key), F.lit(_PLACES)) < int(min(share, 1) * _PLACES)


def _collect(rows: DataFrame, wanted: np.ndarray | None = None) -> Sparse:
    """Features of sampled rows (_k, _t), of all bins or those that wanted marks, one text for each key: that of the least hash."""
    one = rows.groupBy("_k").agg(F.min_by("_t", F.xxhash64("_t")).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "_t"):
            bins, counts, words = [], [], []
            x = features(texts, wanted)
            for i, at in enumerate(np.searchsorted(x.rows, np.arange(x.n))):
                own = slice(at, np.searchsorted(x.rows, i, "right"))
                b, c = x.bins[own], x.counts[own]
                if len(b) > FEATURES:  # a fixed draw of the text's own
                    chosen = np.argsort(mix(b.astype(U64) + U64(len(texts[i]) << BITS)), kind="stable")[:FEATURES]
                    b, c = b[chosen], c[chosen]
                bins.append(b.astype("<u4").tobytes())
                counts.append(np.minimum(c, 65535).astype("<u2").tobytes())
                words.append(int(x.words[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.array(bins, pa.binary()), pa.array(counts, pa.binary()), pa.array(words, pa.int64())], ["k", "bins", "counts", "words"])

    found = sorted(one.mapInArrow(run, "k string, bins binary, counts binary, words long").collect(), key=lambda r: r["k"])
    bins = np.frombuffer(b"".join(r["bins"] for r in found), "<u4").astype(np.int64)
    counts = np.frombuffer(b"".join(r["counts"] for r in found), "<u2").astype(np.int64)
    return Sparse(len(found), np.repeat(np.arange(len(found)), [len(r["bins"]) // 4 for r in found]), bins, counts, np.array([r["words"] for r in found], np.int64))


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """A model from rows that are not held out: those labelled toxic, and a sample of all. Labels other than toxic only give the prior, their toxic share over all rows."""
    ship_package(df.sparkSession)
    known = labels.select(labels["doc_id"].alias("_k"), labels["toxic"].alias("_y")).filter(F.col("_y").isNotNull() & F.col("_k").isNotNull() & ~held_out(F.col("_k")))
    known = known.groupBy("_k").agg(F.max("_y").alias("_y"))
    labelled, toxic = known.agg(F.count(F.lit(1)), F.sum(F.when(F.col("_y") == 1, 1).otherwise(0))).first()
    if not toxic:
        return Model(np.zeros(1 << BITS), fitted=False)
    prior = (toxic + 0.5) / (labelled + 1)
    rows = df.select(df[key].alias("_k"), F.coalesce(df[text], F.lit("")).alias("_t")).filter("_k is not null").filter(~held_out(F.col("_k")))
    chosen = known.filter(F.col("_y") == 1).filter(_chance(POSITIVES / toxic, "_k")).select("_k")  # about POSITIVES keys at most, small enough to broadcast
    n = df.count()
    positive = _collect(rows.join(F.broadcast(chosen), "_k", "left_semi"))
    # Bins that fewer toxic texts have are never selected: they need not come here, nor be kept.
    often = np.bincount(positive.bins, minlength=1 << BITS) >= min(LEAST, max(positive.n, 1))
    place = np.where(often, np.arange(1 << BITS), -1)
    return fit(positive.only(place), _collect(rows.filter(_chance(UNLABELLED / max(n, 1), "_k")), often), prior)


def score_documents(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, held_out, score, predicted.

    Only a row's text gives its score: null and empty texts have the score of a text without features, equal texts have equal scores. Labels of held-out and of null keys are not
    read; several labels of a key count as toxic if one does. Without a toxic label all scores are 0; an empty table gives no rows; other columns are left out.
    """
    model = train(df, labels, key, text)
    bins = np.flatnonzero(model.weights)
    weights = model.weights[bins]
    length, constant, fitted = model.length, model.constant, model.fitted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = np.zeros(1 << BITS)
        full[bins] = weights
        own = Model(full, length, constant, fitted)
        for batch, texts in slices(batches):
            scores = own.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= CALLED).astype(np.int32))], [key, "held_out", "score", "predicted"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias(key), held_out(df[key]).alias("held_out"), df[text].alias("text")).mapInArrow(run, f"`{key}` {kind}, held_out boolean, score double, predicted int")

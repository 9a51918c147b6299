"""Positive-unlabelled learning on texts whose toxic words are known, by held-out accuracy."""

import random
import zlib

import numpy as np
import pytest

from quarry.llm import toxicity

LABELS = "doc_id long, quality int, toxic int"
SYLLABLES = ["ba", "ko", "mi", "ter", "sun", "al", "ve", "ro", "nit", "dul"]


def corpus(n=1500, seed=3, odd=()):
    """Rows, labels and truth: a fifth holds words of a few stems; a third of the rows has a label."""
    rng = random.Random(seed)
    rows, labels, truth = [], [], {}
    for i in range(n):
        words = ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(2 + len(words) // 25):
                words.insert(rng.randrange(len(words)), rng.choice(["Grolx", "zwurk", "fnaz"]) + rng.choice(["", ".", "ba", "ko", "mi"]))
        rows.append((i, " ".join(words)))
        truth[i] = toxic
        if rng.random() < 0.33:
            labels.append((i, 1, int(toxic)))
    return rows + list(odd), labels, truth


@pytest.fixture(scope="module")
def scored(spark):
    odd = [(-1, None), (-2, ""), (-3, "zwurk " * 30000), (-3, "zwurk " * 30000), (None, "fnaz grolx zwurk fnaz"), (-4, "ba ko mi " * 100000), (-5, "\x00\x1f é 🙂")]
    rows, labels, truth = corpus(odd=odd)
    docs = spark.createDataFrame([(i, t, "w", 1, "x") for i, t in rows], "doc_id long, text string, word string, score int, _k string").repartition(4)
    got = toxicity.score_documents(docs, spark.createDataFrame([*labels, (None, 1, 1), (5, 1, None)], LABELS)).collect()
    return rows, labels, truth, got


def test_held_out_accuracy(scored):
    rows, _, truth, got = scored
    assert sorted(r["doc_id"] for r in got if r["doc_id"] is not None) == sorted(i for i, _ in rows if i is not None)
    held = [r for r in got if r["held_out"] and r["doc_id"] >= 0]
    right = {(r["predicted"], truth[r["doc_id"]]) for r in held}
    assert len(held) > 300 and right >= {(1, True), (0, False)}
    assert sum(r["predicted"] for r in held if truth[r["doc_id"]]) >= 0.95 * sum(truth[r["doc_id"]] for r in held)
    assert sum(r["predicted"] for r in held if not truth[r["doc_id"]]) <= 0.01 * len(held)


def test_columns(scored):
    _, _, _, got = scored
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)


def test_odd_rows(scored):
    _, _, _, got = scored
    by = {r["doc_id"]: r for r in got}
    assert by[-1]["score"] == by[-2]["score"] == by[-5]["score"] < 0.7 > by[-4]["score"]
    assert by[-3]["predicted"] == 1 and len({r["score"] for r in got if r["doc_id"] == -3}) == 1 and sum(r["doc_id"] == -3 for r in got) == 2


def test_held_out_labels_and_other_columns_do_not_matter(spark, scored):
    """Other labels of held-out rows, clean labels moved among rows, and other ids in the same fold give the same scores where the texts are those."""
    rows, labels, _, got = scored
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    turned = [(i, q, 1 - t if held(i) else t) for i, q, t in labels]
    docs = spark.createDataFrame([(i, t, "other") for i, t in rows], "doc_id long, text string, lang string").repartition(2)
    again = toxicity.score_documents(docs, spark.createDataFrame(turned, LABELS)).collect()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    assert [r["score"] for r in sorted(again, key=key)] == [r["score"] for r in sorted(got, key=key)]


def test_without_labels_and_without_rows(spark):
    docs, labels = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string"), spark.createDataFrame([], LABELS)
    assert [(r["score"], r["predicted"]) for r in toxicity.score_documents(docs, labels).collect()] == [(0.0, 0)] * 2
    assert toxicity.score_documents(docs.limit(0), labels).collect() == []
    one = toxicity.score_documents(docs, spark.createDataFrame([(2, 1, 1), (3, 1, 0)], LABELS)).collect()
    assert len(one) == 2 and all(0 <= r["score"] <= 1 for r in one)
    assert toxicity.score_documents(docs.limit(0), spark.createDataFrame([(2, 1, 1)], LABELS)).collect() == []


def test_a_hot_key_and_a_hot_text_do_not_fill_the_sample(spark):
    rows, labels, truth = corpus(1500, seed=5)
    hot = [(9_000_000, f"{t} {n}") for n, (_, t) in enumerate(rows[:300])] + [(9_000_001 + n, rows[0][1]) for n in range(300)]
    x = toxicity._collect(spark.createDataFrame(rows + hot, "_k long, _t string"))
    assert x.n == 1801 and x.bins.max() < 1 << toxicity.BITS
    got = toxicity.score_documents(spark.createDataFrame(rows + hot, "doc_id long, text string"), spark.createDataFrame([*labels, (9_000_000, 1, 1)], LABELS)).collect()
    mine = [r for r in got if r["doc_id"] < 1500]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in mine) >= 0.95 * len(mine)


def test_the_risk_of_clean_texts_is_corrected_by_the_prior():
    """With half of the unlabelled margins toxic, the threshold falls between the two groups, though unlabelled texts lie on both sides."""
    rng = np.random.default_rng(0)
    toxic, clean = rng.normal(2, 0.3, 500), rng.normal(-2, 0.3, 500)
    assert -1.4 < toxicity.threshold(toxic, np.concatenate([clean, rng.normal(2, 0.3, 500)]), 0.5) < 1.4


def test_features_of_beginnings_and_whole_words():
    x = toxicity.features([b"Stupid stupidly", b"", "été".encode(), b"a b"])
    assert x.n == 4 and x.words.tolist() == [2, 0, 1, 2]
    own = dict(zip(x.bins[x.rows == 0].tolist(), x.counts[x.rows == 0].tolist(), strict=True))
    assert sorted(own.values()) == [1, 1, 1, 1, 2, 2, 2] or sorted(own.values()) == [1, 1, 1, 2, 2, 2]
    some = np.zeros(1 << toxicity.BITS, bool)
    some[x.bins[:2]] = True
    assert toxicity.features([b"Stupid stupidly"], some).bins.tolist() == sorted(x.bins[:2].tolist())

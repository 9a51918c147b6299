"""Answers used again by age, against a loop over all of them."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.schemas import PAGE
from quarry.session import cut
from quarry.sources.answers import Answers, as_of


def when(c):
    return F.timestamp_micros(F.col(c)).alias(c)


def plain(requests, answers, micros):
    for key, t in requests:
        old = [(a, n) for k, a, n in answers if key is not None and t is not None and k == key and a is not None and a <= t < a + micros]
        yield key, t, max(old, default=(None, None))[1]


@pytest.mark.parametrize("seconds", [1, 7, 60])
def test_latest_fresh_answer(spark, seconds):
    rng = random.Random(seconds)
    keys = ["hot"] * 5 + ["a", "b", None]
    time = lambda: rng.choice([None, rng.randrange(-3_000_000, 90_000_000), rng.randrange(100) * 500_000])
    answers = [(rng.choice(keys), time(), i) for i in range(300)] + [("a", 5_000_000, -1), ("a", 5_000_000, 900)]
    requests = [(rng.choice([*keys, "none"]), time()) for _ in range(400)] + [("a", 5_000_000)] * 3
    got = as_of(spark.createDataFrame(requests, "k string, t long").select("k", when("t")), spark.createDataFrame(answers, "k string, t long, n int").select("k", when("t"), "n"), "k", "t", seconds)
    rows = [(r["k"], r["m"], r["n"]) for r in got.select("k", F.unix_micros("t").alias("m"), F.col("answer.n").alias("n")).collect()]
    text = lambda rows: sorted(map(str, rows))
    assert text(rows) == text(plain(requests, answers, seconds * 1_000_000))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, t timestamp, n int")
    one = spark.createDataFrame([("x", 1)], "k string, t long").select("k", when("t"))
    assert [tuple(r) for r in as_of(one, none, "k", "t", 60).select("k", "answer").collect()] == [("x", None)]
    assert as_of(one.limit(0), none, "k", "t", 60).collect() == []


def test_a_fetch_asks_only_for_what_is_not_fresh(spark):
    asked, now = [], [1000.0]

    def ask(urls):
        own = sorted(r[0] for r in urls.collect())
        asked.append(own)
        return spark.createDataFrame([(u, None if "bad" in u else "200", "text/html", None, f"{u} at {now[0]}") for u in own], PAGE)

    kept = Answers(spark, 60, lambda: now[0])
    fetch = kept.fetch(ask)
    get = lambda *urls: {r["url"]: (r["status"], r["body"]) for r in fetch(spark.createDataFrame([(u,) for u in urls], "url string")).collect()}
    assert get("a", "b", "bad", "a") == {"a": ("200", "a at 1000.0"), "b": ("200", "b at 1000.0"), "bad": (None, "bad at 1000.0")}
    now[0] = 1059.0
    assert get("a", "c", "bad") == {"a": ("200", "a at 1000.0"), "c": ("200", "c at 1059.0"), "bad": (None, "bad at 1059.0")}
    now[0] = 1061.0
    kept.forget()
    assert get("a", "c") == {"a": ("200", "a at 1061.0"), "c": ("200", "c at 1059.0")}
    assert asked == [["a", "b", "bad"], ["bad", "c"], ["a"]]
    assert {r["url"] for r in kept.table().collect()} == {"a", "c"}


def test_validation_sends_nothing_for_fresh_answers(spark):
    from quarry.operators.crawl import validate

    asked = []

    def ask(urls):
        asked.extend(r[0] for r in urls.collect())
        return cut(urls.select("url", F.lit("204").alias("status"), *(F.lit(None).cast("string").alias(c) for c in PAGE.names[2:])), "asked")

    fetch = Answers(spark).fetch(ask)
    fetch(spark.createDataFrame([("x",), ("y",)], "url string"))
    nodes = spark.createDataFrame([("x", "Unknown"), ("y", "200"), ("z", "Unknown")], "url string, status string")
    assert sorted(map(tuple, validate(nodes, fetch).select("url", "status").collect())) == [("x", "204"), ("y", "200"), ("z", "204")]
    assert sorted(asked) == ["x", "y", "z"]

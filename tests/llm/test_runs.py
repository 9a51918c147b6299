"""Periodic runs against brute force: every period compared at every place."""

import hashlib
import time
import zlib

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import runs


def plain(w):
    """(start, length, period) of all runs, by definition."""
    out = []
    for p in range(1, len(w) // 4 + 1):
        same = [a == b for a, b in zip(w, w[p:], strict=False)] + [False]
        start = 0
        for i, x in enumerate(same):
            if not x:
                length = i - start + p
                own = w[start : start + length]
                if i > start and length >= max(6, 4 * p) and not any(own[q:] == own[:-q] for q in range(1, p)):
                    out.append((start, length, p))
                start = i + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def planted(key, w):
    if key is None or not w or zlib.crc32(str(key).encode()) % 10:
        return w
    g = zlib.crc32(str(key).encode()) // 10
    a = g % len(w)
    p = 1 + (len(w) - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]


def digest(w):
    found = plain(w)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    told = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    return len(found), *(best or [None] * 3), best and 1000 * best[1] // best[2], brute.sha(told), brute.sha(" ".join(x for i, x in enumerate(w) if i not in gone))


@given(st.lists(st.integers(0, 2), max_size=40), st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(0, 9), st.lists(st.integers(0, 2), max_size=40))
@settings(max_examples=1500, deadline=None)
def test_runs_of_words(before, block, times, after):
    w = before + block * times + block[: times % (len(block) + 1)] + after
    assert runs.find_runs(np.array(w, np.int64)) == plain(w)


def test_runs_inside_runs_and_over_each_other():
    inner = [1] * 7 + [2]
    w = inner * 5 + [3, 4] * 4 + [4, 3] * 4
    assert runs.find_runs(np.array(w)) == plain(w)
    assert {p for _, _, p in plain(w)} >= {1, 2, 8}


@pytest.mark.parametrize("least", [4, 5, 6, 7, 8])
def test_shortest_runs(least):
    for p in (1, 2, 3):
        w = [9, 8, 7, *[i % p for i in range(least)], 6]
        assert runs.find_runs(np.array(w)) == plain(w) == ([(3, least, p)] if least >= max(6, 4 * p) else [])


def test_documents(spark, docs, rows):
    extra = [(i, f"start {'la di da ' * (i % 9)} {'x ' * i} end of {i} words " + "one two " * (i % 7)) for i in range(1000, 1080)]
    both = docs.select("doc_id", "text", "n", "spans").union(spark.createDataFrame([(*r, 1, "s") for r in extra], "doc_id long, text string, n int, spans string"))
    got = sorted(tuple(r) for r in runs.digest_runs(both, arrange=runs.periodic_tail).collect() if r[0] is not None)
    assert got == sorted((i, *digest(planted(i, brute.words(t)))) for i, t in rows + extra if i is not None)
    assert sum(r[1] > 0 for r in got) > 40 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows + extra if i)
    null = [tuple(r) for r in runs.digest_runs(both, arrange=runs.periodic_tail).filter("doc_id is null").collect()]
    assert null == [(None, *digest(brute.words(t))) for i, t in rows if i is None]


def test_runs_and_collapsed_texts(spark):
    data = [(1, "a b  a b\na b a b c"), (2, None), (3, ""), (4, "no runs here"), (1, "a b  a b\na b a b c"), (5, "é " * 6)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(map(tuple, runs.runs_of_documents(df).collect())) == [(1, 0, 8, 2), (1, 0, 8, 2), (5, 0, 6, 1)]
    assert sorted(map(tuple, runs.collapse_runs(df).collect())) == [(1, "a b c"), (1, "a b c"), (2, ""), (3, ""), (4, "no runs here"), (5, "é")]


def test_empty_table_and_rows_without_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert runs.digest_runs(empty).collect() == [] == runs.runs_of_documents(empty).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    got = runs.digest_runs(spark.createDataFrame([(7, None), (7, " \n")], empty.schema), arrange=runs.periodic_tail).collect()
    assert [tuple(r) for r in got] == [(7, 0, None, None, None, None, nothing, nothing)] * 2


@pytest.mark.parametrize("made", [lambda n: np.zeros(n, np.uint64), lambda n: np.arange(n, dtype=np.uint64) % 1000, lambda n: np.random.default_rng(1).integers(0, 2, n), lambda n: np.arange(n, dtype=np.uint64) % (n // 4)])
def test_work_grows_little_faster_than_the_text(made):
    def took(n):
        began = time.process_time()
        runs.find_runs(made(n))
        return time.process_time() - began

    took(20_000)
    assert took(320_000) < 16 * 4 * max(took(20_000), 0.02)

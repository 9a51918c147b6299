"""The filter audit against brute force: every order run through document by document."""

import itertools
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest

from quarry.llm import interactions

LABELS = "doc_id long, quality int, toxic int, part string, n int"


def failures(text, key, least):
    w = brute.words(text)
    out = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
    return out + "E" * (key is not None and least.get(text) is not None and least[text] < key)


def audited(rows, labels):
    """{(part, order, step): counts} of rows (key, text, part) and labels {key: (good, toxic)}."""
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    docs = [(part or "", failures(text or "", key, least), *labels.get(key, (0, 0))) for key, text, part in rows]
    out, shapley = {}, defaultdict(int)
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, itertools.permutations("ABCDE")):
            alive = list(own)
            for step, letter in enumerate(order, 1):
                gone, left = [d for d in alive if letter in d[1]], [d for d in alive if letter not in d[1]]
                out[part, order, step] = (len(left), len(gone), sum(letter in d[1] for d in own) - len(gone), sum(d[1] == letter for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone))
                shapley[part, letter] += len(gone)
                alive = left
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_every_order_and_step(spark, rows):
    sources = ["a", "b", None, "", "c"]
    data = [(i, t, sources[n % 5], "x") for n, (i, t) in enumerate(rows)]
    labels = [(i, i % 3 == 0, i % 5 == 0, "p", 1) for i, _, _, _ in data if i is not None and i % 2] + [(3, 0, 1, "p", 1), (3, 1, 0, "p", 1), (None, 1, 1, "p", 1), (10**6, 1, 1, "p", 1), (5, None, None, "p", 1)]
    known = defaultdict(lambda: [0, 0])
    for i, good, toxic, _, _ in labels:
        if i is not None:
            known[i] = [max(known[i][0], int(good or 0)), max(known[i][1], int(toxic or 0))]
    got = interactions.audit_documents(spark.createDataFrame(data, "doc_id long, text string, source string, n string").repartition(5), spark.createDataFrame([(i, None if g is None else int(g), None if t is None else int(t), p, n) for i, g, t, p, n in labels], LABELS))
    expected = audited([r[:3] for r in data], known)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == expected
    assert got.count() == len(expected) == 600 * 4


def test_many_copies_and_one_hot_key(spark):
    """A third of the rows are copies, a third have one key, a third have none."""
    prose = " ".join(f"w{i}" for i in range(60))
    rows = [(i, prose, "s") for i in range(200)] + [(-1, f"{prose} {i % 50}", "s") for i in range(200)] + [(None, f"{prose} {i % 50}", None) for i in range(200)]
    labels = {-1: (1, 1), 7: (1, 0)}
    got = interactions.audit_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame([(k, *v, "", 0) for k, v in labels.items()], LABELS))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == audited(rows, labels)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5])
def test_neighbouring_orders_differ_by_one_swap(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for j in interactions.plain_changes(n):
        order[j], order[j + 1] = order[j + 1], order[j]
        seen.add(tuple(order))
    assert seen == set(itertools.permutations(range(n)))


def test_only_two_steps_change_at_a_time(monkeypatch):
    """5 steps at first, then two for each of 119 swaps."""
    worked, real = Counter(), interactions.Walk._work_out
    monkeypatch.setattr(interactions.Walk, "_work_out", lambda self, place: (worked.update([place]), real(self, place))[1])
    names, counts = interactions.Walk(np.ones((2, 32, 3), np.int64), "ABCDE").run()
    assert len(set(names)) == 120 and sum(worked.values()) == 5 + 2 * 119 and counts.shape == (120, 5, 2, 7)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], "doc_id long, text string, source string"), spark.createDataFrame([], LABELS)
    assert interactions.audit_documents(docs, labels).collect() == []
    some = spark.createDataFrame([(1, None, None)], docs.schema)
    got = interactions.audit_documents(some, labels).collect()
    assert len(got) == 600 and all(r["part"] == "" and r["kept"] in (0, 1) for r in got) and sum(r["removed"] for r in got) == 120

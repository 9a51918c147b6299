"""The ten operators against brute force, on documents with nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm import bpe, components, fingerprints, jaccard, packing, pii, quality, ranks, registry, secrets, sharding, substrings, token_counts

BYTES = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def text_of(rows):
    """Texts by id, of ids that have one text."""
    return {i: t for i, t in rows}


def same_rows(got, rows, expected):
    """Each row's values, by id, as often as it stands there."""
    assert Counter(got) == Counter((i, *expected(i, t)) for i, t in rows)


# 1


def test_token_counts(docs, rows):
    tokens = set(bpe.read_ranks(BYTES))
    longest = max(map(len, tokens))

    def greedy(word):
        at = n = 0
        while at < len(word):
            end = min(len(word), at + longest)
            while word[at:end] not in tokens:
                end -= 1
            at, n = end, n + 1
        return n

    got = [tuple(r) for r in token_counts.count_tokens(docs, BYTES).collect()]
    same_rows(got, rows, lambda i, t: (len((t or "").encode().split()), sum(greedy(b" " + w) for w in (t or "").encode().split())))


def test_longest_match_without_a_token_is_one_unknown():
    m = token_counts.LongestMatch([b"ab", b"abcd", b"c", b"bc", b"d"])
    assert [m.count(w) for w in (b"ab", b"abc", b"abcd", b"abcdc", b"abd", b"x", b"abx", b"", b"bcd", b"a")] == [1, 2, 1, 2, 2, 1, 1, 0, 2, 1]


# 2


def test_personal_data_base(docs, rows):
    found = pii.digest(pii.find_personal(docs)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    counts = lambda spans: tuple(sum(k == kind for k, _, _ in spans) for kind in pii.KINDS)
    same_rows([tuple(r) for r in found.collect()], rows, lambda i, t: (*counts(s := brute.personal(t)), brute.sha(brute.joined(s))))


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "a@@b.c", "@b.c", "x.@y..z", "a@b.c.@d.e", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.002.003.004", "0000000000256.1.1.1", "4111-1111-1111-1111 1", "+1.2-3(4)5 678 9+12345678", "++12345678", "1 2 3 4", "5" * 300, "é@b.c x@b.c"])
def test_personal_data_of_odd_texts(text):
    assert pii.find_base(text) == brute.personal(text)


def test_terms_that_reveal_are_found_and_masked(spark):
    filler = [f"word{i % 7} common text about nothing {i}" for i in range(40)]
    told = [f"{a} said zorblax wrote from jane@corp.net yesterday {b}" for a, b in (("report", "evening"), ("memo", "noon"), ("letter", "dawn"), ("note", "dusk"))]
    docs = spark.createDataFrame(list(enumerate([*told, *filler])), "doc_id long, text string")
    found = {r["doc_id"]: r for r in pii.digest(pii.find_personal(docs)).collect()}
    begin = told[0].index("zorblax")
    assert f"term:{begin}:{begin + 7}" in found[0]["spans"] and all(found[i]["spans"] == "" for i in range(4, 44))
    masked = {r["doc_id"]: r["text"] for r in pii.sanitize(docs).collect()}
    assert "[EMAIL]" in masked[0] and "zorblax" not in masked[0] and masked[10] == filler[6]


def test_copies_prove_nothing(spark):
    docs = spark.createDataFrame([(i, "zorblax wrote from jane@corp.net") for i in range(9)] + [(i, f"other {i}") for i in range(9, 30)], "doc_id long, text string")
    assert {r["spans"] for r in pii.digest(pii.find_personal(docs)).collect()} == {"email:19:32", ""}


def test_copies_disprove_nothing(spark):
    told = [f"{chr(97 + i) * 5} zorblax wrote from jane@corp.net {chr(107 + i) * 5}" for i in range(10)]
    texts = [*told, *[told[3]] * 1000, *(f"filler {i}" for i in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = [r["spans"] for r in pii.digest(pii.find_personal(docs)).orderBy("doc_id").collect()]
    assert all("term:6:13" in s for s in spans[:1010]) and not any(spans[1010:])


def test_terms_far_from_an_entity_are_found_and_masked_wherever_they_stand(spark):
    between = " ".join(f"common{chr(97 + i % 9)}" for i in range(40))
    told = [f"Dear Zorblax {a * 4} {between} jane@corp.net {between} yours, zorblax {a * 5}" for a in "abcd"]
    near = [f"{a * 4} quuxley wrote from joe@corp.net {a * 5} {between} and quuxley again" for a in "efgh"]
    filler = [f"word {between} {chr(97 + i % 26) * (3 + i // 26)}" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate([*told, *near, *filler])), "doc_id long, text string")
    masked = [r["text"] for r in pii.sanitize(docs).orderBy("doc_id").collect()]
    assert not any("zorblax" in t.lower() or "quuxley" in t or between not in t for t in masked[:8]) and masked[8:] == filler


def test_sanitize_keeps_rows_and_columns(docs, rows):
    out = pii.sanitize(docs)
    assert out.schema == docs.schema
    same_rows([(r["doc_id"], r["text"], r["_id"], r["_row"]) for r in out.collect()], rows, lambda i, t: (None if t is None else pii.mask(t, brute.joined(brute.personal(t)), [], 1), "u", "w"))


def test_one_document_proves_nothing(spark):
    told = "soon jane@corp.net now. " + "filler " * 20 + "soon again jane@corp.net and now. " + "other " * 20 + "soon for jane@corp.net even now."
    docs = spark.createDataFrame([(0, told), *((i, f"filler {i}") for i in range(1, 200))], "doc_id long, text string")
    assert "term" not in pii.digest(pii.find_personal(docs)).orderBy("doc_id").first()["spans"]


def test_disclosures_by_brute_force(spark):
    texts = brute.disclosing_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    policy = pii.Policy()
    own, where, contexts = defaultdict(set), defaultdict(set), defaultdict(set)
    mentions = {}
    for t in set(texts):
        base = brute.personal(t)
        held = [(f"{k}:{t[b:e]}", b, e) for k, b, e in base]
        terms = defaultdict(list)
        for term, b, e in pii._outside(t, base):
            terms[term].append((b, e))
        mentions[t] = terms
        for term in terms:
            where[term].add(t)
        for entity, b, e in held:
            own[entity].add(t)
            near = {x for x, s in terms.items() if any(c >= b - policy.window and d <= e + policy.window for c, d in s)}
            for term, spans in terms.items():
                around = [(b, e)] if term in near else spans
                contexts[entity, term].add(tuple(t[max(0, c - policy.window) : d + policy.window] for c, d in around))
    n = len(set(texts))
    expected = {}
    for t in set(texts):
        spans = {}
        for entity in [x for x, s in own.items() if t in s]:
            for term in mentions[t]:
                pair = own[entity] & where[term]
                share = 1 + math.log(len(pair) / len(where[term])) / math.log(max(n / len(own[entity]), 2))
                if min(len(pair), len(contexts[entity, term])) >= policy.support and share >= policy.generalise:
                    spans |= {s: max(share, spans.get(s, 0)) for s in mentions[t][term]}
        expected[t] = sorted((*s, round(x, 9)) for s, x in spans.items())
    got = {r["doc_id"]: [(s["start"], s["end"], round(s["share"], 9)) for s in r["terms"]] for r in pii.find_personal(docs).collect()}
    assert got == {i: expected[t] for i, t in enumerate(texts)} and sum(map(len, got.values())) > 40


# 3


def test_sharding(docs, rows):
    got = sharding.shard_documents(docs, sharding.even_tree(16)).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert len({(r["doc_id"], r["shard"], r["grown_shard"]) for r in got}) == len({i for i, _ in rows})
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16 and r["law"] == "key"
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_weights_and_move_inside_changed_subtrees(spark):
    tree = sharding.even_tree(16)
    heavier = [s if s.number != 5 else sharding.Shard(5, s.region, s.rack, 2.0) for s in tree]
    keys = spark.range(40000)
    rows = keys.select(sharding.shard_of([F.col("id")], tree).alias("a"), sharding.shard_of([F.col("id")], heavier).alias("b"), sharding.shard_of([F.col("id")], sharding.grown(tree)).alias("c")).collect()
    counts = Counter(r["a"] for r in rows)
    assert all(abs(counts[i] - 2500) < 5 * math.sqrt(2500) for i in range(16))
    assert Counter(r["b"] for r in rows)[5] > 1.5 * counts[5]
    region = lambda n: n // 8
    # Keys that leave a region come into the one whose weight grew; none go the other way.
    assert all(region(r["a"]) == region(r["b"]) or region(r["b"]) == 0 for r in rows)
    assert all(r["a"] == r["b"] for r in rows if region(r["b"]) == 1)
    moved = [r for r in rows if r["c"] != r["a"]]
    assert {r["c"] for r in moved} == {16} and abs(len(moved) - 40000 / 17) < 300
    assert spark.range(1).select(sharding.shard_of([F.col("id")], [])).first()[0] is None


def test_ranks_have_no_gaps(spark):
    df = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id % 50 AS string)) AS g", "id % 10 AS tie")
    groups = defaultdict(list)
    for r in ranks.gapless_rank(df, "g", ["tie", "id"], "k", buckets=16).collect():
        groups[r["g"]].append(r["k"])
    assert all(sorted(v) == list(range(len(v))) for v in groups.values())


# 4


def test_quality_counts(docs, rows):
    got = quality.score_documents(docs).select("doc_id", *quality.COUNTS, "base_failed").collect()

    def expected(i, t):
        n, chars, symbols, dup, again = brute.quality(t)
        return n, chars, symbols, dup, again, n < 50 or 100 * again > 50 * n

    same_rows([tuple(r) for r in got], rows, expected)


def test_verdict_does_not_depend_on_the_order(rows):
    texts = [(t or "").encode() for _, t in rows]
    verdicts = [quality.run_cascade(texts, rules).tolist() for rules in (quality.RULES, quality.RULES[::-1], quality.RULES[2:] + quality.RULES[:2])]
    assert verdicts[0] == verdicts[1] == verdicts[2] and any(verdicts[0]) and not all(verdicts[0])


def test_cascade_order_is_rejection_per_cost_of_what_is_left():
    now = [0.0]

    def rule(name, cost, rejects):
        def run(f):
            now[0] += cost * len(f.texts)
            return np.array([rejects(t) for t in f.texts])

        return quality.Rule(name, run)

    # "ab" rejects most of all but nothing that "a" leaves except b; "never" is cheap and useless.
    rules = [rule("never", 0.001, lambda t: False), rule("ab", 3.0, lambda t: t in (b"a", b"b")), rule("a", 1.0, lambda t: t == b"a"), rule("c", 1.0, lambda t: t == b"c")]
    texts = [b"a"] * 60 + [b"b"] * 10 + [b"c"] * 20 + [b"d"] * 10
    measured = quality.estimate(texts, rules, clock=lambda: now[0])
    assert [m[0] for m in measured] == ["a", "c", "ab", "never"]
    assert [round(m[2], 6) for m in measured] == [0.6, 0.5, 0.5, 0.0] and [round(m[1], 6) for m in measured] == [1.0, 1.0, 3.0, 0.001]
    assert [r.name for r in quality.cascade_order(rules, measured[:2])] == ["a", "c", "never", "ab"]
    assert quality.estimate([], rules) == []


def test_later_rules_do_not_work_on_rejected_texts():
    seen = []
    rules = [quality.Rule("long", lambda f: f.n_words > 3), quality.Rule("spy", lambda f: seen.extend(f.texts) or f.n_lines > 1)]
    assert quality.run_cascade([b"a b c d", b"a", b"a\nb", b""], rules).tolist() == [False, True, False, True] and seen == [b"a", b"a\nb", b""]


def test_the_sample_is_drawn_from_all_rows(spark):
    drawn = quality.sampled(spark.range(0, 20000, 1, 8).selectExpr("cast(id AS string) AS text"), "text", 400)
    ids = sorted(int(t) for t in drawn)
    assert 300 < len(ids) < 500 and ids[0] < 1000 and ids[-1] > 19000 and len(quality.sampled(spark.range(9).selectExpr("cast(null AS string) AS text"), "text", 400)) == 9


def test_short_texts_stay_without_a_least_length():
    texts = [b"three clean words", b"", b"12 34 56 78 -- 90", b"word " * 30]
    assert quality.run_cascade(texts, quality.ANY_LENGTH).tolist() == [True, False, False, False]


def test_filter_keeps_what_scores_as_kept(docs):
    kept = Counter(r["doc_id"] for r in quality.score_documents(docs).filter("kept").collect())
    out = quality.filter_documents(docs)
    assert out.schema == docs.schema and Counter(r["doc_id"] for r in out.collect()) == kept


def test_rules_leave_prose_and_reject_junk():
    prose = ("The quick brown fox jumps over the lazy dog while seven wise owls read books about far rivers and old towns near green hills " * 1 + " ".join(f"word{i} goes on" for i in range(30))).encode()
    junk = ("menu | home | shop | cart | help | about | login | terms | press | jobs | " + " | ".join(f"item{i}" for i in range(60))).encode()
    assert quality.run_cascade([prose, junk, b""], quality.RULES).tolist() == [True, False, False]


# 5


def test_repeated_passages(docs, rows):
    gone = brute.removed(rows)

    def expected(i, t):
        w, flags = brute.words(t), gone[i, t]
        return len(w), sum(flags), brute.sha(" ".join(x for x, g in zip(w, flags, strict=True) if not g))

    got = [tuple(r) for r in substrings.digest_documents(docs).collect()]
    same_rows(got, rows, expected)
    assert sum(r[2] > 0 for r in got) > 8


def test_short_spans(docs, rows):
    gone = brute.removed(rows, 12)
    got = {(r["doc_id"], r["n_removed"]) for r in substrings.digest_documents(docs, 12, 4).collect()}
    assert got == {(i, sum(gone[i, t])) for i, t in rows}


def test_remove_repeats_keeps_rows_and_columns(docs, rows):
    gone = brute.removed(rows)
    out = substrings.remove_repeats(docs)
    assert out.schema == docs.schema
    expected = lambda i, t: (t if t is None or not any(gone[i, t]) else " ".join(x for x, g in zip(brute.words(t), gone[i, t], strict=True) if not g), "v")
    same_rows([(r["doc_id"], r["text"], r["_body"]) for r in out.collect()], rows, expected)


def test_factors_are_greedy_matches(spark, docs, rows):
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(brute.words(t))
    got = [tuple(r) for r in substrings.factor_documents(docs).collect()]
    by = defaultdict(list)
    for key, start, length, ref, at in got:
        assert ref is None or ref < key
        mine, other = texts[key][0], next(w for w in texts[ref] if w[at : at + length] == texts[key][0][start : start + length])
        # No factor stops short of its match's end.
        assert start + length == len(mine) or at + length == len(other) or mine[start + length] != other[at + length]
        by[key].append((start, start + length))
    for spans in by.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    long = [i for i, t in rows if t and len(t.split()) >= 2990]
    assert (long[1], 0, 2990, long[0], 0) in got


def test_greedy_parse_takes_the_match_that_reaches_furthest():
    assert substrings.greedy_parse([(0, 100, 1, 7), (40, 160, 2, 0), (90, 200, 3, 5), (230, 260, 4, 0)]) == [(0, 100, 1, 7), (100, 100, 3, 15), (230, 30, 4, 0)]
    assert substrings.greedy_parse([]) == []


def test_anchors_depend_on_their_window_alone():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3, 400)).encode() for _ in range(30)]
    alone = [substrings.find_anchors(b := substrings.Batch([t]), b.hashes(), 50, 16) for t in texts]
    b = substrings.Batch(texts)
    doc, grams, place, first, last = substrings.find_anchors(b, b.hashes(), 50, 16)
    for i, own in enumerate(alone):
        mine = doc == i
        assert (own[1] == grams[mine]).all() and all((x == y[mine] - b.word_from[i]).all() for x, y in zip(own[2:], (place, first, last), strict=True))


@pytest.mark.parametrize("seed", range(3))
def test_passages_shuffled_between_documents(spark, seed):
    """Few words, so that windows repeat inside texts, shift and meet at factor boundaries."""
    import random

    rng = random.Random(seed)
    pool = [[f"w{rng.randrange(6)}" for _ in range(rng.randint(20, 400))] for _ in range(12)]
    rows = []
    for i in range(70):
        words = []
        for _ in range(rng.randint(1, 5)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            words += p[a : a + rng.randint(1, 300)] + [f"x{rng.randrange(3)}"] * rng.randrange(2)
        rows.append((rng.randrange(60) if i % 9 == 0 else i, " ".join(words)))
    gone = brute.removed(rows)
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.digest_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == Counter((i, len(brute.words(t)), sum(gone[i, t])) for i, t in rows)


# 6


def test_fingerprints(docs, rows):
    ordered = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], (r[1] or "").encode()))
    texts = [t or "" for _, t in ordered]
    edited = [t[: len(t) - len(t) // 2] + texts[(i + 1) % len(texts)][: len(t) // 2] for i, t in enumerate(texts)]
    got = fingerprints.fingerprint_documents(docs).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == Counter((i, len(t), brute.sha(e)) for (i, _), t, e in zip(ordered, texts, edited, strict=True))
    prints = defaultdict(set)
    for r in got:
        prints[text_of(rows)[r["doc_id"]] if r["doc_id"] is not None else rows[-1][1]].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert all(len(p) == 1 for p in prints.values())
    long = [r for r in got if r["n_chars"] > 600 and " " in (text_of(rows)[r["doc_id"]] or "")]
    assert sum(r["near_edited"] > r["near_next"] for r in long) > 0.7 * len(long)


def _hash(values, seed=42):
    """Spark's xxhash64 of strings, longs and ints, one after another."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else int(v).to_bytes(8 if not isinstance(v, np.int32) else 4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return seed - (seed >> 63 << 64)


def brute_anchors(text, k=fingerprints.K, s=fingerprints.S):
    words = brute.words(text)
    inner = [_hash(words[i : i + s]) for i in range(len(words))]
    closed = [i for i in range(len(words) - k + 1) if min(inner[i : i + k - s + 1]) in (inner[i], inner[i + k - s])]
    return [(_hash(words[i : i + k]), i) for i in closed] or ([(_hash(words), 0)] if words else [])


def brute_links(text):
    a = brute_anchors(text)
    return {_hash([x, y, np.int32(q - p)]) for (x, p), (y, q) in zip(a, a[1:], strict=False)} | ({_hash([a[-1][0]])} if a else set())


def brute_print(text):
    return "".join(f"{h % 2**64:016X}" for h in sorted(brute_links(text)))


def brute_likeness(a, b):
    x, y = brute_links(a), brute_links(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def check_fingerprints(spark, rows):
    """Fingerprints and likeness of rows without long words or scripts without spaces, by brute force."""
    ordered = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], _hash([r[1] or ""])))
    expected = []
    for (i, t), (_, u) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        t, u = t or "", u or ""
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        expected.append((i, len(t), brute.sha(e), brute_print(t), brute_print(e), brute_likeness(t, e), brute_likeness(t, u)))
    got = fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, got)) == Counter(expected)


def test_fingerprints_by_brute_force(spark, rows):
    plain = [(i, t) for i, t in rows if all(len(w) <= fingerprints.LONG for w in brute.words(t))]
    check_fingerprints(spark, plain)
    few = [" ".join(f"w{i * 7 + j}" for j in range(n)) for i in range(12) for n in range(12)]
    check_fingerprints(spark, [(i * (2**55) - 2**62, t) for i, t in enumerate(few)])
    check_fingerprints(spark, [(None, t) for t in few[:9]] + [(5, t) for t in few[9:30]] + [(6, "a b c")] * 3)
    check_fingerprints(spark, [(3, "one row only")])


def test_fingerprints_with_many_buckets(spark, monkeypatch, rows):
    monkeypatch.setattr(fingerprints, "ROWS", 2)
    monkeypatch.setattr(fingerprints, "COARSE", 8)
    plain = [(i, t) for i, t in rows if all(len(w) <= fingerprints.LONG for w in brute.words(t))]
    check_fingerprints(spark, plain)
    check_fingerprints(spark, [(None, t) for _, t in plain[:30]] + [(-(2**63), "x y")] + [(7, t) for _, t in plain[:40]] + [((i or 0) * 3**30, t) for i, t in plain])


def test_syncmers_are_context_free(spark):
    words = [f"w{i * i % 97}" for i in range(300)]
    texts = [" ".join(words), " ".join(["before", "it", *words]), "a b", "", " ".join(words[:150] + ["gap"] * 9 + words[150:])]
    df = fingerprints.with_anchors(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "a").withColumn("l", fingerprints.links(F.col("a")))
    rows = {r["i"]: r for r in df.collect()}
    assert [[tuple(a) for a in rows[i]["a"]] for i in range(4)] == [brute_anchors(t) for t in texts[:4]]
    # A shift leaves all links but none or a few at the ends; an insertion breaks those that span it.
    assert set(rows[0]["l"]) <= set(rows[1]["l"]) and len(set(rows[0]["l"]) - set(rows[4]["l"])) <= 4


def test_texts_without_spaces_have_likeness(spark):
    rng = np.random.default_rng(5)
    draw = lambda letters, n: "".join(rng.choice(list(letters), n))
    letters = {"han": [chr(0x4E00 + i) for i in range(2000)], "thai": [chr(0x0E01 + i) for i in range(46)], "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "emoji": [chr(0x1F300 + i) for i in range(300)]}
    texts = [draw(chars, 600) for chars in letters.values()]
    got = fingerprints.fingerprint_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == 4 and all(0.15 < r["near_edited"] < 0.6 and r["near_next"] < 0.05 for r in got)


def test_texts_with_words_have_an_anchor(spark):
    texts = [" ".join(f"w{i * 7 + j}" for j in range(n)) for i in range(60) for n in (5, 6)]
    df = fingerprints.with_anchors(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t", "a")
    prints = [r[0] for r in df.select(fingerprints.as_string(fingerprints.links(F.col("a")))).collect()]
    assert "" not in prints and len(set(prints)) == 120


# 7


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_jaccard_components(docs, rows, k, percent):
    expected = brute.components(rows, k, percent)
    got = [tuple(r) for r in jaccard.join_documents(docs, jaccard.Join(k, percent)).collect()]
    same_rows(got, rows, lambda i, t: expected[i, t])


def test_jaccard_with_small_tiles_and_many_classes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 4)
    import random

    rng = random.Random(3)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(120):
        w = list(base if i % 2 else base[:30])
        for _ in range(rng.randint(0, 9)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((1, 80), (2, 70)):
        expected = brute.components(rows, k, percent)
        same_rows([tuple(r) for r in jaccard.join_documents(docs, jaccard.Join(k, percent)).collect()], rows, lambda i, t: expected[i, t])


@pytest.mark.parametrize("tile", [4, 512])
def test_all_links_between_classes(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    import random

    rng = random.Random(4)
    base, rows = [f"b{i}" for i in range(40)], []
    for i in range(90):
        w = list(base if i % 2 else base[:36])
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, t) for i, t in rows[:20]] + [(200, None), (201, "")]
    sets = {i: frozenset(brute.words(t)) for i, t in rows}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s, i)
    named = sorted((i, s) for s, i in first.items() if s)
    expected = {(i, j) for i, x in named for j, y in named if i < j and 100 * len(x & y) >= 80 * len(x | y)}
    links, members = jaccard.link_classes(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Join(1, 80))
    got = [tuple(r) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == expected and len(got) > 100
    assert {(r["doc_id"], r["class_id"]) for r in members.collect()} == {(i, first[s] if s else i) for i, s in sets.items()}


def test_a_shingle_of_many_classes(spark):
    """One shingle in 3,000 different sets, no two of which link, and a chain of near copies among them."""
    rows = [(i, "common " + " ".join(f"u{i}x{j}" for j in range(6))) for i in range(3000)]
    rows += [(5000 + i, "common " + " ".join(f"c{j}" for j in range(i, i + 30))) for i in range(8)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join_documents(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Join(1, 90)).collect()}
    assert got == {i: i if i < 5000 else 5000 for i, _ in rows}


def test_signatures_never_hide_a_link():
    rng = np.random.default_rng(5)
    join = jaccard.Join(4, 85)
    for n in (3, 100, 700, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: max(1, int(len(a) * 0.95))], rng.integers(0, 2**63, max(1, n // 50), dtype=np.uint64)]))
        overlap = len(np.intersect1d(a, b))
        x, y = (np.frombuffer(jaccard.signature(s), np.uint8) for s in (a, b))
        size = min(len(x), len(y))
        if 100 * overlap >= 85 * (len(a) + len(b) - overlap):
            assert jaccard.may_link(jaccard.fold(x, size), jaccard.fold(y, size)[None, :], len(a), np.array([len(b)]), join)[0]


def test_keep_first(docs, rows):
    expected = brute.components(rows, 5, 80)
    out = jaccard.keep_first(docs)
    assert out.schema == docs.schema
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter({key: 1 for key, (_, c) in expected.items() if c == key[0]})


def test_components(spark):
    chain = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 230)] + [(7, 7), (500, 501)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 200 for i in range(200, 230)} | {500: 500, 501: 500}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 8


def test_packing(docs, rows):
    tokenizer = Tokenizer.from_file(WORDS)
    expected = []
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, n, at, len(ids[at : at + 4096]), zlib.crc32(ids[at : at + 4096].tobytes())) for n, at in enumerate(range(0, len(ids), 4096))]
    got = packing.pack_documents(docs, WORDS).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(expected)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for at, length in sorted(places):
            assert at == end
            end += length
        assert end <= 4096
    assert len(bins) == math.ceil(sum(e[3] for e in expected) / 4096)


def test_packing_ids_are_those_of_the_library():
    tokenizer = Tokenizer.from_file(WORDS)
    texts = ["hello <|startoftext|> x <|endoftext|> y", "a<|ENDOFTEXT|>b", "<|endoftext|>", "x<|endoftext|><|endoftext|>z", "<|endoftext|", "it's 12 ½ é ß don't", "", "Ünïcode İstanbul ﬁ", "a\x00b\u200bc", "日本 語"]
    rng = np.random.default_rng(9)
    letters = ["<|endoftext|>", "<|", "|>", "endoftext", " ", "A", "'s", "\n", "7", "é", "²", "!?", "\xa0", "\u3000", "ß"]
    texts += ["".join(rng.choice(letters, rng.integers(1, 12))) for _ in range(400)]
    packed = packing.WordTokenizer(open(WORDS, encoding="utf-8").read()).packed(texts)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("histogram", [{}, {4096: 3}, {1: 10000}, {3000: 5, 1096: 4, 548: 2}, {2049: 7}, {n: (n * 7919) % 13 for n in range(1, 4097)}])
def test_bins_hold_all_pieces(histogram):
    combinations = packing.minimum_bin_slack(histogram, 4096)
    held = Counter()
    for c in combinations:
        assert sum(n * k for n, k in c.lengths) <= 4096
        held.update({n: k * c.bins for n, k in c.lengths})
    assert held == Counter({n: c for n, c in histogram.items() if c})
    least = max(math.ceil(sum(n * c for n, c in histogram.items()) / 4096), sum(c for n, c in histogram.items() if n > 2048))
    assert sum(c.bins for c in combinations) <= least * 1.01 + 1


def test_fullest_is_the_best_subset():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(60):
        counts = {int(n): int(c) for n, c in zip(rng.integers(1, 40, 5), rng.integers(1, 4, 5), strict=True)}
        room = int(rng.integers(1, 120))
        best = max(s for s in (sum(n * k for n, k in zip(counts, ks, strict=True)) for ks in itertools.product(*(range(c + 1) for c in counts.values()))) if s <= room)
        chosen = packing.fullest(room, sorted(counts, reverse=True), counts)
        assert sum(n * k for n, k in chosen.items()) == best and all(k <= counts[n] for n, k in chosen.items())


# 9


def test_byte_bpe(docs, rows):
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTES, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def expected(i, t):
        ids = np.array(encoding.encode_ordinary(t or ""), "<u4")
        return len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), brute.sha(t or "")

    encoded = bpe.encode_documents(docs, BYTES, public_tokenizers.PATTERN)
    same_rows([tuple(r)[:4] for r in encoded.collect()], rows, expected)
    same_rows([(r["doc_id"], bytes(r["bytes"])) for r in bpe.decode_documents(encoded, BYTES).collect()], rows, lambda i, t: ((t or "").encode(),))


@pytest.mark.parametrize("n", [0, 1, 2, 10, 5000])
def test_perfect_hash(n):
    keys = [f"k{i}".encode() for i in range(n)]
    table = bpe.PerfectHash(keys)
    assert [table.find(k) for k in keys] == list(range(n)) and sorted(table.at) == list(range(n))
    assert table.find(b"other") == -1


# 10


def test_secrets_base(docs, rows):
    got = secrets.digest(secrets.find_secrets(docs)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256").collect()
    counts = lambda s: tuple(sum(k == kind for k, _, _ in s) for kind in secrets.STRONG)
    same_rows([tuple(r) for r in got], rows, lambda i, t: (*counts(s := brute.secrets(t)), brute.sha(brute.joined(s))))


def test_weak_parts_need_their_complements(spark):
    texts = [
        "client_id=web-app-1 then password=hunter22 at https://api.h.net/v1",
        "client_id=web-app-1 " + "x " * 200 + "password=hunter22 at https://api.h.net/v1",
        "see https://api.h.net/v1 and client_id=web-app-1",
        "AKIA12345678 near abcdEFGH0123456789abcdEFGH0123456789xyz",
        "abcdEFGH0123456789abcdEFGH0123456789xyz alone",
        "token=token=abcdef " * 700,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in secrets.digest(secrets.find_secrets(df)).collect()}
    kinds = lambda i: [s.split(":")[0] for s in got[i]["spans"].split(",") if s]
    assert kinds(0) == ["weak_access", "assign", "endpoint"] and kinds(1) == ["assign", "endpoint"] and kinds(2) == []
    assert kinds(3) == ["weak_access", "weak_secret"] and kinds(4) == []
    assert got[5]["n_assign"] == 700 and got[5]["base_sha256"] == brute.sha(brute.joined(brute.secrets(texts[5])))


def brute_secret_spans(text, scope=secrets.SCOPE):
    """All spans of a text, by pairs."""
    base = brute.secrets(text)
    strong = [(k, b, e) for k, b, e in base]
    found = lambda kind, pattern, ok=lambda m: True: [(kind, m.start(), m.end()) for m in re.finditer(pattern, text, re.ASCII) if ok(m)]
    access = found("weak_access", secrets.ACCESS, lambda m: m.end() - m.start() < 20) + found("weak_access", secrets.NAMED, lambda m: len(m[2]) >= 4)
    over = lambda x, y: x[1] < y[2] and y[1] < x[2]
    near = lambda x, y: not over(x, y) and y[1] <= x[2] + scope and y[2] >= x[1] - scope
    mixed = [x for x in found("weak_secret", secrets.MIXED) if not any(over(x, y) for y in strong + access)]
    ends = found("endpoint", secrets.ENDPOINT)
    secret = [x for x in strong if x[0] != "access"] + mixed
    linked = [x for x in access + ends if any(near(x, y) for y in secret)]
    linked += [x for x in mixed if any(near(x, y) for y in access + ends + [x for x in strong if x[0] == "access"])]
    rank = [*secrets.STRONG, *secrets.WEAK]
    return ",".join(f"{k}:{b}:{e}" for k, b, e in sorted(set(strong + linked), key=lambda s: (s[1], rank.index(s[0]), s[2])))


def test_linked_spans_by_brute_force(spark):
    texts = brute.credential_texts()
    got = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    assert got == {i: brute_secret_spans(t) for i, t in enumerate(texts)}
    assert sum("weak_secret" in s for s in got.values()) > 40 and sum("endpoint" in s for s in got.values()) > 40


# All


def test_empty_tables(empty):
    assert token_counts.count_tokens(empty, BYTES).count() == 0
    assert pii.digest(pii.find_personal(empty)).count() == 0 and pii.sanitize(empty).count() == 0
    assert sharding.shard_documents(empty, sharding.even_tree(16)).count() == 0
    assert quality.score_documents(empty).count() == 0 and quality.filter_documents(empty).count() == 0
    assert substrings.digest_documents(empty).count() == 0 and substrings.remove_repeats(empty).count() == 0
    assert fingerprints.fingerprint_documents(empty).count() == 0
    assert jaccard.join_documents(empty).count() == 0 and jaccard.keep_first(empty).count() == 0
    assert packing.pack_documents(empty, WORDS).count() == 0
    assert bpe.encode_documents(empty, BYTES, public_tokenizers.PATTERN).count() == 0
    assert secrets.digest(secrets.find_secrets(empty)).count() == 0


def test_a_key_of_many_rows_is_split(spark):
    """Rows without a key, a third of all, do not come to one bucket."""
    rows = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "concat('text ', id) AS text")
    got = sharding.shard_documents(rows, sharding.even_tree(16)).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert len(got) == 3000 and all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) >= 1000


def test_very_long_texts(spark, tmp_path):
    """Texts of a megabyte and more: prose, one word, digits, marks, one line again and again, no spaces, beside short ones."""
    rng = np.random.default_rng(3)
    vocabulary = ["".join(chr(97 + int(c)) for c in rng.integers(0, 26, int(n))) for n in rng.integers(2, 10, 5000)]
    prose = " ".join(vocabulary[int(i)] for i in rng.integers(0, 5000, 200_000))
    texts = [prose, prose[:600_000] + " end " + prose[600_000:], "a" * 1_000_000, "0123456789" * 60_000, "<|$#" * 100_000, "the same line\n" * 80_000, "\u4e2d\u6587" * 150_000, "key=\"" * 100_000, "a@b.c " * 100_000, " " * 1_000_000, "x y", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for name, query in registry.QUERIES.items():
        rows = query(spark, str(tmp_path)).collect()
        assert {r["doc_id"] for r in rows} == set(range(len(texts))), name
        if name.startswith("op5"):
            assert {r["doc_id"]: r["n_removed"] for r in rows}[1] > 190_000
        if name.startswith("op7"):
            assert {r["doc_id"]: r["component_id"] for r in rows}[1] == 0


def test_registered_queries_cover_whole_tables(spark, tables, rows):
    for name, query in registry.QUERIES.items():
        n = query(spark, tables).select("doc_id").distinct().count()
        assert n == len({i for i, _ in rows if i is not None}) + 1, name


# 2, lists of contacts


def test_lists_of_contacts_are_paired_by_classes(spark):
    """Three lists of the same 4,000 contacts: 16 million pairs of an entity and a term in each, of one class each. Names near their own address only are proved by the others'."""
    import random

    rng = random.Random(5)
    lines = [f"n{''.join(rng.choices('abcdefgh', k=7))} p{i}@mail.net" for i in range(4000)]
    texts = ["\n".join([f"list {name}", *rng.sample(lines, len(lines))]) for name in ("one", "two", "three")]
    docs = spark.createDataFrame([*enumerate(texts), *((100 + i, f"other text of number {i}") for i in range(50))], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find_personal(docs)).collect()}
    assert all(found[i].count("email:") == 4000 for i in range(3)) and all(found[i].count("term:") == 4001 for i in range(3))
    assert all(found[100 + i] == "" for i in range(50))


def test_one_entity_in_a_class_is_proved_only_far_from_its_term(spark):
    """In three texts the same words stand beside the first address, so that they have one context there; the second address is far away, and the words' own contexts are one as well."""
    filler = " ".join(["und"] * 40)
    same = [f"{filler} zorb first@a.net zorb {filler}" for _ in range(3)]
    texts = [t + f" {'x1 ' * 60} second@a.net {i}" for i, t in enumerate(same)]
    other = [f"{t.replace('zorb', 'zarb')} number{i}" for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*enumerate(texts), *((10 + i, t) for i, t in enumerate(other)), *((50 + i, f"plain {i}") for i in range(40))], "doc_id long, text string")
    found = pii.digest(pii.find_personal(docs)).collect()
    assert not any("term:" in r["spans"] for r in found if r["doc_id"] < 3)


def test_masked_rows_and_others(spark):
    rows = [(i, t, i % 2) for i, t in enumerate(["a@b.net", None, "", "plain", "a@b.net", "call +1 555 123 4567"] * 5)] + [(0, "a@b.net", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _hash int")
    got = pii.sanitize(df).collect()
    put = {"a@b.net": "[EMAIL]", "call +1 555 123 4567": "call [PHONE]"}
    assert Counter(map(tuple, got)) == Counter((i, put.get(t, t), n) for i, t, n in rows)


# 6, buckets


def test_fingerprint_buckets_follow_the_rows(spark, monkeypatch):
    """Ten times the rows have ten times the buckets, of as many rows; buckets ascend with (key, tie), whatever the keys."""
    monkeypatch.setattr(fingerprints, "ROWS", 16)
    monkeypatch.setattr(fingerprints, "COARSE", 32)
    kinds = {
        "dense": F.col("i"),
        "sparse": F.col("i") * (2**47) - 2**62,
        "hot": F.when(F.col("i") % 3 == 0, -(2**63)).otherwise(F.col("i") - 500),
        "few": F.col("i") % 3,
        "clumped": F.when(F.col("i") % 2 == 0, F.col("i")).otherwise(2**60 + F.col("i")),
    }
    for name, key in kinds.items():
        sizes = {}
        for n in (4_000, 40_000):
            rows = spark.range(n).select(F.col("id").alias("i")).select(key.cast("long").alias("order_id"), F.xxhash64("i").alias("tie"))
            got = fingerprints._bucketed(rows).collect()
            ordered = sorted((r["order_id"], r["tie"], r["bucket"]) for r in got)
            assert len(got) == n and [b for _, _, b in ordered] == sorted(b for _, _, b in ordered), name
            sizes[n] = Counter(b for _, _, b in ordered)
        if name == "clumped":  # the two percentiles about the gap
            assert sorted(sizes[40_000].values())[-2] <= 160 and max(sizes[40_000].values()) <= 1.1 * 40_000 / 32
        else:
            assert max(sizes[40_000].values()) <= 160 and max(sizes[40_000].values()) <= 3 * max(sizes[4_000].values()), (name, max(sizes[4_000].values()), max(sizes[40_000].values()))
        assert len(sizes[40_000]) >= 4 * len(sizes[4_000]), name

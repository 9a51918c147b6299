"""One walk for all rules: the rules it names, and the same rows as rule by rule."""

import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.errors import HandlerError
from quarry.functions.patterns import folded, needed
from quarry.operators import extract, multiscan
from quarry.rules import DEFAULT_RULES, LEGACY_RULES, PROSE_RULES, Rule, link_rules, loaded

PACKS = [loaded(DEFAULT_RULES), LEGACY_RULES, PROSE_RULES, link_rules()]
PIECES = ["password=Abc1", "PASSWORD=x", "rememberMe=", "=DELETEME", "swagger-ui.html", "a/b.js.map", "10.0.0.1", " 10.1.2.3", "LTAIabcdefgh1234", "acceſſKeyId", "acceßkey", "Key", "İ", "ı", "a@b.com", "'", '"', "href=/x/y", "https:", 'token = "', "é", "\n", "13273487666", "Swagger uı"]


@pytest.mark.parametrize(
    ("regex", "strings"),
    [
        ("(=deleteMe|rememberMe=)", {"=deleteme", "rememberme="}), ("Abc[0-9]+de", {"abc"}), ("a(bc)d", {"abcd"}), ("(a|)bcd", {"bcd"}), ("(?:ab|c)?x", {"x"}), ("[ab]c*", set()), ("x|", set()), ("(?:abc){2,}d", {"abc"}), ("(?=abc)d", {"d"}),
        ("(?x) a b # c", {"ab"}), ("KKk", {"k"}), ("straße", {"stra"}), (r"\babc\b", {"abc"}), ("", set()), ("abc|abd|x", {"abc", "abd", "x"}), ("abc|abd", {"ab"}), ("é=x", {"=x"}), ("(?>abc)d", {"abcd"}),
    ],
)
def test_strings_that_a_match_needs(regex, strings):
    assert needed(regex) == strings


def test_letters_of_other_alphabets_that_match_ascii_ones():
    for i in range(128, 0x11000):
        for letter in "abcdefghijklmnopqrstuvwxyz":
            if re.fullmatch(letter, chr(i), re.I):
                assert folded(chr(i)) == letter
    assert folded("ÀB") == folded("Àb") == "À".encode().lower().decode("latin-1") + "b"


@given(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), st.sampled_from(PACKS))
@settings(max_examples=400, deadline=None)
def test_no_rule_that_matches_is_left_out(text, pack):
    found = multiscan.candidate_finder(pack)(text)
    assert {i for i, r in enumerate(pack) if re.search(r.regex, text, re.I)} <= set(found)


def test_same_rows_as_rule_by_rule(spark):
    texts = ["".join(PIECES[(i * 7 + j * 3) % len(PIECES)] for j in range(6)) for i in range(60)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "type int, t string").withColumnRenamed("type", "candidates")
    for pack in PACKS:
        rows = lambda engine: sorted(map(tuple, extract.extract_secrets(df, "t", pack, engine).collect()))  # noqa: B023, E731
        assert rows("scan") == rows("whole")
        hits = lambda f: {r["name"]: (r["hits"], r["texts"]) for r in f(df, "t", pack).collect()}  # noqa: B023, E731
        assert sorted(hits(multiscan.scan_hits)) == sorted(r.name for r in pack) and hits(multiscan.scan_hits) == hits(extract.rule_hits)


def test_no_rules_and_two_of_one_name(spark):
    df = spark.createDataFrame([("x",)], "t string")
    assert multiscan.scan_secrets(df, "t", []).collect() == [] == multiscan.scan_hits(df, "t", []).collect()
    with pytest.raises(HandlerError):
        multiscan.scan_secrets(df, "t", [Rule("a", "x"), Rule("a", "y")])


def test_a_hundred_times_the_rules_cost_little_more():
    text = " ".join(f"word{i % 977} of text, no. {i}" for i in range(40_000))
    few, many = ([*PROSE_RULES, *(Rule(f"r{i}", f"zq{i:04d}[a-z]+") for i in range(n))] for n in (0, 500))

    def took(rules):
        find = multiscan.candidate_finder(rules)
        best = []
        for _ in range(5):
            began = time.process_time()
            find(text)
            best.append(time.process_time() - began)
        return min(best)

    assert took(many) < 2 * took(few) + 0.01

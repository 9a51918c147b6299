"""Extraction against Python's own engine, links, DOM and titles."""

import re

import pytest

from quarry.errors import ConfigError, HandlerError
from quarry.functions.patterns import required
from quarry.operators import dom, extract, links
from quarry.rules import DEFAULT_RULES, LEGACY_RULES, PROSE_RULES, Rule, link_rules, loaded, rules_from

TEXTS = [
    "map: /xx/static/one.js.map and /static/swagger-ui.html here",
    "id 130528200011110000 and '13273487666' or 13273487666",
    'mail "abc@qq.com" or abc@qq.com, "ü.x@bücher.de"',
    "ip 10.0.0.1 and x192.168.1.1.1.1; 172.16.0.9",
    "Accesskeyid=x AccessKeySecret LTAIabcdefgh1234",
    "xxx=deleteme rememberme=true",
    "'9c65a3ebabdb448b4476b114ee574a6f' \"E9d7e49a027469b78ad956903617f8ed\"",
    'jwt "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0"',
    "line sep\rand /login?redirect=http://xx)",
    "",
    None,
]
PAGE = '<html><head><title> A\nB </title><link href="/l"/></head><body><a href="http://h.net/x?y#z">t</a><a href=\'rel/p\'>u</a><a name="n">v</a><script src="1.js"></script><script src="x.txt"></script><img src="i.png"><a href="/pic.png">w</a></body></html>'


def by_python(text, rules, engine):
    out = []
    for r in rules:
        p = re.compile(r.regex, re.I)
        for m in p.finditer(text or ""):
            value = m[0] if engine != "groups" or not p.groups else m[1] or ""
            if (r.name, value) not in out:
                out.append((r.name, value))
            if engine == "first":
                break
    return sorted(out)


@pytest.mark.parametrize("engine", ["groups", "first", "whole", "scan"])
@pytest.mark.parametrize("pack", [loaded(DEFAULT_RULES), LEGACY_RULES, PROSE_RULES, link_rules()])
def test_engines_agree_with_python(spark, engine, pack):
    texts = [*TEXTS, PAGE]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {}
    for r in extract.extract_secrets(df, "t", pack, engine).collect():
        got.setdefault(r["i"], []).append((r["type"], r["data"]))
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == by_python(t, pack, engine), t


@pytest.mark.parametrize(
    ("regex", "literal"),
    [("[a-z]+@[a-z]+", "@"), ('token = "([0-9]{4})"', ' = "'), ("(password)=(x)", "="), (r"(?:[0-9]{1,3}\.){3}[0-9]", "."), ("a|@", ""), ("(@)?x", ""), ("@*", ""), ("(?!@)x", ""), ("(?=@)x", ""), ("(?<=@)x", ""), (r"x\b@\b=", "@="), ("[@=]", ""), ("K@S", "@"), ("(?:@=)+?y", "@="), ("(?x) a @ b", "@"), (r"(x)\1-", "-"), ("ß1ſ", "1"), ("", "")],
)
def test_what_a_match_must_hold(regex, literal):
    assert required(regex) == literal


def test_every_default_rule_is_found(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    assert {r["type"] for r in extract.extract_secrets(df, "t", loaded(DEFAULT_RULES)).collect()} == {r.name for r in DEFAULT_RULES if r.loaded}


def test_no_rules_and_no_engine(spark):
    df = spark.createDataFrame([("x",)], "t string")
    assert extract.extract_secrets(df, "t", []).count() == 0
    with pytest.raises(HandlerError):
        extract.extract_secrets(df, "t", [], "other")


def test_titles(spark):
    pages = [PAGE, "<TITLE>x</TITLE><title lang=en>y\r</title>", "none", None, "<title>\t&nbsp; a &amp;amp; b&#228;&#x1F600;&eacute;&nope; & c;&lt;\u3000\x85\n</title>", "<title>&#0;&#xD800;&#1114112;x</title>"]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, h string")
    assert [r[0] for r in rows.orderBy("i").select(extract.titles(rows["h"])).collect()] == ["A B", "x|y", "", None, "a &amp; bä\U0001f600é&nope; & c;<", "\ufffd\ufffd\ufffdx"]


def test_dom_references():
    assert dom.references(PAGE) == ["/l", "http://h.net/x?y#z", "rel/p", "1.js", "/pic.png"]
    assert dom.references("xxxxxx") == [] and dom.references(None) == []


@pytest.mark.parametrize("unit", ["<li>some words of text here", "<b>bold ", "<p>par<a href='x'>link", "<div>", "</x><i>", "<td>c<tr>", "<ul><li>a", "<option>o"])
def test_dom_of_large_pages_with_open_elements(unit):
    """Time grows with the page, not with its square."""
    import time

    page = "<ul><table>" + unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    n = len(dom.elements(page))
    assert dom.references(page) == (["x"] if "href" in unit else [])
    assert n > 50_000 // len(unit) and time.perf_counter() - began < 12


def test_open_elements_end_where_the_next_begins():
    texts = [(e["tag"], e["text"]) for e in dom.elements("<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul><p>x<b>y<p>z<table><tr><td>1<td>2<tr><td>3</table>w")]
    assert texts == [("ul", "abcde"), ("li", "a"), ("li", "bcd"), ("ul", "c"), ("li", "c"), ("li", "e"), ("p", "xy"), ("b", "y"), ("p", "z123w"), ("table", "123"), ("tr", "12"), ("td", "1"), ("td", "2"), ("tr", "3"), ("td", "3")]


def test_rules_are_those_users_run():
    """Values written out, as they stand in users' settings."""
    values = {r.name: r.regex for r in DEFAULT_RULES}
    assert values["Suspicious API Key"] == "[\"'][0-9a-zA-Z]{32}['\"]"
    assert values["Phone"] == "['\"](1(3([0-35-9]\\d|4[1-8])|4[14-9]\\d|5([\\d]\\d|7[1-79])|66\\d|7[2-35-8]\\d|8\\d{2}|9[89]\\d)\\d{7})['\"]"
    assert values["Email"] == "['\"]([\\w]+(?:\\.[\\w]+)*@(?:[\\w](?:[\\w-]*[\\w])?\\.)+[\\w](?:[\\w-]*[\\w])?)['\"]"
    assert values["Jwt"] == "['\"](ey[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9._-]{10,}|ey[A-Za-z0-9_\\/+-]{10,}\\.[A-Za-z0-9._\\/+-]{10,})['\"]"
    assert not any('\\"' in r.regex for r in DEFAULT_RULES + LEGACY_RULES if r.name != "Swagger")


def test_links_are_resolved(spark):
    df = spark.createDataFrame([("https://base.org/dir/page", PAGE)], "base string, html string")
    found = {r["url"]: r["kind"] for r in links.dom_links(df, "base", "html").collect()}
    assert found == {"https://base.org/l": "url", "http://h.net/x?y#z": "url", "https://base.org/rel/p": "url", "https://base.org/1.js": "js"}
    text = "fetch('//cdn.net/a/b') \"ftp-x/y\" =https://h.net/q action=/no"
    df = spark.createDataFrame([("https://base.org/dir/page", text)], "base string, html string")
    assert {r["url"] for r in links.pattern_links(df, "base", "html").collect()} == {"https://cdn.net/a/b", "https://base.org/ftp-x/y", "https://h.net/q"}


def test_dom_elements(spark):
    df = spark.createDataFrame([(1, PAGE), (2, "plain"), (3, None)], "i int, h string")
    rows = {r["i"]: r["elements"] for r in dom.dom_elements(df, "h", lambda e: [x for x in e if x["tag"] == "a"] or None).collect()}
    assert list(rows) == [1] and [e["text"] for e in rows[1]] == ["t", "u", "v", "w"]
    assert dom.dom_elements(df, "h", lambda e: []).count() == 3


def test_rule_files():
    one = {"name": "A", "regex": "x", "loaded": True}
    assert rules_from([one, one | {"regex": "y"}, one | {"name": "B", "loaded": "true"}]) == [Rule("A", "y")]
    assert rules_from([{"group": "g", "rule": [one]}]) == [Rule("A", "x")]
    for bad in (None, {}, ["x"], [{"name": "A"}], [one | {"regex": "("}]):
        with pytest.raises(ConfigError):
            rules_from(bad)

"""Elements as a table function: text by places, in memory that follows the page."""

import pytest

from quarry.operators import dom

PAGE = "<html><body>x<div>a<b>c</b>d<a href='/1'>one<a href=/2>t&amp;o</a></div>é<p>q<p>r<script>s</script></body></html>"


def rows(html, tags=""):
    return list(dom.HtmlElements().eval(html, tags))


def test_places_and_texts():
    text = rows(PAGE, "#text")[0]
    assert text == (0, "#text", {}, 0, 13, "xacdonet&oéqrs")[:4] + (len("xacdonet&oéqrs"), "xacdonet&oéqrs")
    for (n, tag, attrs, begin, end, own), e in zip(rows(PAGE), dom.elements(PAGE), strict=True):
        assert tag == e["tag"] and attrs == e["attrs"] and text[5][begin:end] == e["text"] and own in (None, e["text"])
    assert [r[1:] for r in rows(PAGE, "a")] == [("a", {"href": "/1"}, 4, 7, "one"), ("a", {"href": "/2"}, 7, 10, "t&o")]
    assert [r[0] for r in rows(PAGE, " b , p ")] == [1, 2, 3] and rows(None) == [] == rows("", "a") == rows("plain", "b")


@pytest.mark.parametrize("unit", ["<a href=x>t", "<b>t", "<li>t", "<p>t", "<div>t", "<td>t", "<font>t", "<a href=x><b>t", "<span>t</a>"])
def test_rows_are_as_long_as_the_page(unit):
    html = unit * 20_000
    found = rows(html)
    assert len(found) >= 20_000 and sum(len(r[5] or "") for r in found) <= len(html)
    if unit.startswith("<a href=x>t"):
        assert all(r[5] == "t" for r in found) and sum(len(e["text"]) for e in dom.elements(html)) == 20_000


def test_lateral(spark):
    dom.register_functions(spark)
    spark.createDataFrame([(1, PAGE), (2, None), (3, "no html"), (4, "<i>z")], "n int, html string").createOrReplaceTempView("dom_pages")
    got = spark.sql("SELECT p.n AS page, e.n, e.tag, e.attrs['href'] AS href, e.text FROM dom_pages p, LATERAL html_elements(p.html, 'a,i') e")
    assert sorted(map(tuple, got.collect())) == [(1, 1, "a", "/1", "one"), (1, 2, "a", "/2", "t&o"), (4, 1, "i", None, "z")]
    every = spark.sql("SELECT p.n, count(*) AS c FROM dom_pages p, LATERAL html_elements(p.html, null) e GROUP BY p.n")
    assert {r["n"]: r["c"] for r in every.collect()} == {1: len(dom.elements(PAGE)), 4: 1}

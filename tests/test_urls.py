"""URL functions against the standard library and truth tables."""

from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from quarry.functions import urls
from quarry.schemas import URL_PARTS

URLS = [
    "http://h/a/b;p?q=1#f", "HTTPS://User:pw@H.com:8080/x", "//host/x", "mailto:a@b.c", "#f", "a/b", "/a;p?q#f", "?q", "", "/a b", "http://h/{x}", "http://h.com", "foo", "/x;y/z", "/x/y;v;w", "http://[::1]:80/a", "a:b/c", "http:/one", "1a:b",
]


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", make(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


def test_parts_as_the_standard_library_has_them(spark):
    got = column(spark, URLS, urls.url_parts)
    for url, parts in zip(URLS, got, strict=True):
        assert tuple(parts[n] for n in URL_PARTS) == tuple(urlparse(url)), url


def test_joined_parts_are_the_url_again(spark):
    for url, got in zip(URLS, column(spark, URLS, lambda c: urls.url_join(urls.url_parts(c))), strict=True):
        if not url.startswith("http:/o"):
            assert got == urlparse(url).geturl(), url


@pytest.mark.parametrize(
    ("netloc", "expected"),
    [("h", ("h", "")), ("h:80", ("h", "80")), (" h : 80 ", ("h", "80")), ("[::1]:80", ("", "")), ("u:p@h:1", ("", "")), ("", ("", ""))],
)
def test_host_port(spark, netloc, expected):
    assert tuple(column(spark, [netloc], urls.host_port)[0]) == expected


def test_root_domain(spark):
    hosts = ["www.example.com", "a.b.co.uk", "127.0.0.1", "localhost", "x.com.cn", "co.uk", ""]
    assert column(spark, hosts, urls.root_domain) == ["example.com", "b.co.uk", "127.0.0.1.", "localhost.", "x.com.cn", "co.uk", "."]


def test_static_paths(spark):
    paths = ["/a.png", "/a.PNG", "/a.css?v=1", "/a.tsx", "/a.ts", "/png", "/a.ico/b"]
    assert column(spark, paths, urls.is_static) == [True, False, True, False, True, False, False]


def test_sanitize(spark):
    links = ["/ok", "---", "javascript:x", "http://localhost/a", "http%3A%2F%2F127.0.0.1%2F", "a b", "http://example.com/", "x{y}", r"http:\/\/h.net\/p", "a;b"]
    assert column(spark, links, urls.sanitize_url) == ["/ok", "", "", "", "", "ab", "", "", "http://h.net/p", ""]


def test_kinds(spark):
    assert column(spark, ["/a.js", "/a.js.map", "/a.js?x", "/a.jsx", "/a"], urls.link_kind) == ["js", "js", "js", "url", "url"]


def test_rate_domain(spark):
    assert column(spark, ["http://U@H.com:80/x", "/x", "http://h"], urls.rate_domain) == ["h.com", "/x", "h"]

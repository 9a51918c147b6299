"""Crawls of small sites: depth, limits, evasion, shared children, reports."""

import pytest

from quarry.errors import CrawlError
from quarry.operators import crawl as c
from quarry.operators import reports
from quarry.rules import PROSE_RULES
from quarry.sources.files import seeds

SITE = {
    "http://s.net/": ("200", "text/html", '<title>Home</title><a href="/a">a</a><a href="/b">b</a><a href="/logout">x</a><script src="1.js"></script> me@mail.net'),
    "http://s.net/a": ("200", "text/html", '<a href="/c">c</a><a href="/b">b</a><a href="http://other.org/">o</a>'),
    "http://s.net/b": ("404", "text/html", "you@mail.net"),
    "http://s.net/c": ("200", "image/png", '<a href="/d">d</a>'),
    "http://s.net/1.js": ("200", "application/javascript", 'token = "' + "ab" * 20 + '"'),
    "http://s.net/d": ("200", "text/html", ""),
    "http://s.net/logout": ("200", "text/html", "no@mail.net"),
}


@pytest.fixture(scope="module")
def fetch(spark):
    rows = [(u, s, t, str(len(b)), b) for u, (s, t, b) in SITE.items()]
    return c.pages_fetch(spark.createDataFrame(rows, "url string, status string, content_type string, content_length string, body string"))


def run(spark, fetch, **plan):
    return c.crawl(seeds(spark, "http://s.net/"), fetch, c.CrawlPlan(rules=PROSE_RULES, **plan))


def test_depth_one_fetches_seeds_and_their_children(spark, fetch):
    done = run(spark, fetch)
    assert {r["url"] for r in done.fetched.collect()} == {"http://s.net/", "http://s.net/a", "http://s.net/b", "http://s.net/1.js"}
    nodes = {r["url"]: r for r in done.nodes.collect()}
    assert nodes["http://s.net/"]["title"] == "Home" and nodes["http://s.net/b"]["status"] == "404"
    assert nodes["http://s.net/logout"]["status"] == "Unknown" and nodes["http://s.net/c"]["status"] == "Unknown"
    assert {(r["type"], r["data"]) for r in done.findings.collect()} == {("Bare Email", "me@mail.net"), ("Bare Email", "you@mail.net"), ("Token", "ab" * 20)}
    edges = {(r["parent"], r["child"], r["kind"]) for r in done.edges.collect()}
    assert {("http://s.net/", "http://s.net/b", "url"), ("http://s.net/a", "http://s.net/b", "url"), ("http://s.net/", "http://s.net/1.js", "js")} <= edges


def test_no_limit_and_domains(spark, fetch):
    done = run(spark, fetch, max_depth=0, allow="*s.net")
    # A picture's links are not followed, so /d is never seen; the other host is recorded and not fetched.
    assert {r["url"] for r in done.fetched.collect()} == {"http://s.net/", "http://s.net/a", "http://s.net/b", "http://s.net/c", "http://s.net/1.js"}
    assert {r["netloc"] for r in reports.found_domains(done.edges).collect()} == {"s.net", "other.org"}


def test_page_limit_takes_urls_in_order(spark, fetch):
    done = run(spark, fetch, max_pages=2)
    assert done.pages == 2 and {r["url"] for r in done.fetched.collect()} == {"http://s.net/", "http://s.net/1.js"}


def test_reports(spark, fetch):
    done = run(spark, fetch)
    rows = {r["URL"]: r for r in reports.csv_rows(done.nodes, done.edges, done.findings, done.fetched).collect()}
    assert rows["http://s.net/"]["Secrets"] == "Bare Email: me@mail.net" and rows["http://s.net/logout"]["Response Code"] == "Unknown"
    lines = reports.urls_per_domain(done.edges, done.nodes, seeds(spark, "http://s.net/"))
    assert {r["bucket"]: r["n"] for r in reports.domain_counts(lines).collect()} == {"s.net": 4, "Other": 1}
    shown = reports.domain_report(lines, "URL from")
    assert shown.index("4 URL from s.net:") < shown.index("http://s.net/a [200]") < shown.index("1 URL from Other:\nhttp://other.org/ [Unknown]")
    none = reports.urls_per_domain(done.edges, done.nodes, seeds(spark, "http://s.net/"), "url", [(900, 901)])
    assert {r["bucket"]: r["n"] for r in reports.domain_counts(none).collect()} == {"s.net": 0, "Other": 0}
    assert reports.domain_report(none, "URL from") == "\n0 URL from s.net:\n\n\n0 URL from Other:\n\n"
    assert "2 URLs from http://s.net/" in reports.text_report(reports.children_by_parent(done.edges, done.nodes, "url"), "URLs from", "parent", "lines")
    assert reports.text_report(reports.secrets_by(done.findings.limit(0), "url"), "x", "url", "secrets", "No secrets found.\n") == "No secrets found.\n"


def test_validate_changes_unknown_only(spark, fetch):
    done = run(spark, fetch)
    nodes = {r["url"]: r["status"] for r in c.validate(done.nodes, fetch).collect()}
    assert nodes["http://s.net/logout"] == "200" and nodes["http://other.org/"] == "Unknown" and nodes["http://s.net/b"] == "404"


def test_validate_keeps_digits_beside_an_unknown_of_the_same_url(spark):
    nodes = spark.createDataFrame([("x", "404"), ("x", "Unknown"), ("y", None), ("z", "Unknown"), ("z", "500")], "url string, status string")
    fetch = c.pages_fetch(spark.createDataFrame([("x", "204"), ("y", "200")], "url string, status string"))
    assert sorted(map(tuple, c.validate(nodes, fetch).select("url", "status").collect())) == [("x", "204"), ("x", "404"), ("y", "200"), ("z", "500"), ("z", "Unknown")]


def test_validate_by_another_column_than_the_url(spark):
    nodes = spark.createDataFrame([(1, "x", "Unknown"), (2, "x", "Unknown"), (3, "x", "404"), (4, None, "Unknown")], "n long, url string, status string")
    fetch = c.pages_fetch(spark.createDataFrame([(1, "204"), (3, "200"), (4, "301")], "n long, status string"), "n")
    assert sorted(map(tuple, c.validate(nodes, fetch, "n").select("n", "status").collect())) == [(1, "204"), (2, "Unknown"), (3, "404"), (4, "301")]


def test_bfs_and_first_parent(spark):
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 0), (3, 4), (9, 9)], "parent long, child long")
    start = spark.createDataFrame([(0,)], "node long")
    assert {r["node"]: r["depth"] for r in c.bfs_depths(edges, start, 9).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
    from pyspark.sql import functions as F

    assert {r["child"]: r["parent"] for r in c.first_parents(edges.withColumn("depth", F.lit(0))).collect()}[3] == 1


def test_seeds(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("http://a\n\n http://b \nhttp://a\nhttp://c\n")
    assert {r["url"] for r in seeds(spark, " http://d ", str(tmp_path / "urls.txt")).collect()} == {"http://a", "http://b", "http://c", "http://d"}
    with pytest.raises(CrawlError):
        seeds(spark)


def test_parts_can_be_replaced(spark, fetch):
    from pyspark.sql import functions as F

    done = run(spark, fetch, wanted=lambda netloc: netloc == "s.net", find_secrets=lambda df, text: df.select("url", F.lit("T").alias("type"), F.lit("d").alias("data")), find_links=lambda df, base, text: df.select(base, F.lit("http://s.net/d").alias("url"), F.lit("url").alias("kind")))
    assert {r["url"] for r in done.fetched.collect()} == {"http://s.net/", "http://s.net/d"} and done.findings.count() == 2


def test_log(tmp_path):
    import logging

    from quarry.log import init_log, level_of

    assert level_of("warning") == logging.WARNING and level_of("none") == logging.CRITICAL and level_of("info", debug=True) == logging.DEBUG
    init_log("info", folder=str(tmp_path)).info("hello")
    assert "hello" in (tmp_path / "quarry.log").read_text()
    init_log()


def test_single_links_and_a_table_of_denied_hosts(spark, fetch):
    done = run(spark, fetch, append=lambda parent, child, kind: ~child.endswith("/b") | (kind == "js"))
    assert {r["url"] for r in done.fetched.collect()} == {"http://s.net/", "http://s.net/a", "http://s.net/1.js"}
    assert "http://s.net/b" not in {r["child"] for r in done.edges.collect()}
    done = run(spark, fetch, denied=spark.createDataFrame([("*.org",), ("s.*",)], "glob string"))
    assert done.pages == 0
    done = run(spark, fetch, max_depth=2, denied=spark.createDataFrame([("*.org",), ("oth*",)], "glob string"))
    assert {r["url"] for r in done.nodes.filter("depth is not null").collect()} == {f"http://s.net/{p}" for p in ("", "a", "b", "c", "1.js")}

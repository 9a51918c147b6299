"""Breadth-first crawl, a level at a time: fetch, extract, anti-join with what was seen."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.errors import CrawlError
from quarry.functions.status import links_wanted, unknown_status
from quarry.functions.text import strip
from quarry.functions.urls import host_port, url_parts
from quarry.operators.extract import extract_secrets, titles
from quarry.operators.filters import domain_filter, is_dangerous
from quarry.operators.links import extract_links
from quarry.operators.tables import by_globs
from quarry.rules import DANGEROUS_PATHS, DEFAULT_RULES, Rule, link_rules, loaded
from quarry.session import cut, drop

#: urls(url) -> (url, status, content_type, content_length, body); a url without a row, or with a null status, failed.
Fetch = Callable[[DataFrame], DataFrame]


@dataclass
class CrawlPlan:
    """What a crawl does. max_depth and max_pages of 0 or less: no limit.

    wanted(netloc), find_secrets(df, text) and find_links(df, base, text) replace the domain filter, the rules and the link extraction: they take and
    give what domain_filter, extract_secrets and extract_links do. append(parent, child, kind) says which single links count as found; denied is a table of
    patterns (glob) of hosts that are not visited.
    """

    rules: list[Rule] = field(default_factory=lambda: loaded(DEFAULT_RULES))
    links: list[Rule] = field(default_factory=link_rules)
    engine: str = "groups"
    allow: str | None = None
    deny: str | None = None
    dangerous: list[str] = field(default_factory=lambda: list(DANGEROUS_PATHS))
    max_depth: int = 1
    max_pages: int = 1000
    wanted: Callable[[Column], Column] | None = None
    find_secrets: Callable[[DataFrame, str], DataFrame] | None = None
    find_links: Callable[[DataFrame, str, str], DataFrame] | None = None
    append: Callable[[Column, Column, Column], Column] | None = None
    denied: DataFrame | None = None


@dataclass
class CrawlResult:
    """nodes: url, depth, status, content_length, content_type, title; edges: parent, child, kind; findings: url, type, data; fetched: url."""

    nodes: DataFrame
    edges: DataFrame
    findings: DataFrame
    fetched: DataFrame
    pages: int


def frontier_after(children: DataFrame, visited: DataFrame) -> DataFrame:
    """Distinct children that were not visited: an anti-join."""
    return children.select("url").distinct().join(visited.select("url"), "url", "left_anti")


def capped(frontier: DataFrame, left: int | None) -> DataFrame:
    """The first pages of a frontier by url, so that a limit always gives the same pages."""
    return frontier if left is None else frontier.orderBy("url").limit(max(0, left))


def first_parents(edges: DataFrame) -> DataFrame:
    """(child, parent, depth): of the parents of a child the one of least depth, then url."""
    order = Window.partitionBy("child").orderBy("depth", "parent")
    return edges.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select("child", "parent", "depth")


def bfs_depths(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(node, depth) of the nodes within `most` steps of the seeds, or of all that they reach, over edges (parent, child)."""
    level = cut(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "level")
    seen = level
    for depth in count(1) if most is None else range(1, most + 1):
        step = level.join(edges, level["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct()
        level = cut(step.join(seen, "node", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if level.isEmpty():
            break
        seen = seen.union(level)
    return seen


def pages_fetch(pages: DataFrame, by: str = "url") -> Fetch:
    """A fetch from a table of pages by url, or by another column that tells requests apart: a left join with one row for each."""
    once = pages.dropDuplicates([by])
    return lambda urls: urls.select(by).distinct().join(once, by, "left")


def crawl(seeds: DataFrame, fetch: Fetch, plan: CrawlPlan) -> CrawlResult:
    """Crawl from seeds(url). Depth 1 fetches the seeds and the pages they link to.

    Statuses belong to urls: every parent of a page sees the same. The page limit takes urls in order. A link that cannot be read is dropped. Each
    level is written to the shared folder; a level's work depends on its own pages and on the urls seen.
    """
    if plan.max_depth < 0:
        raise CrawlError("max_depth is negative")
    netloc = url_parts(F.col("url"))["netloc"]
    path = url_parts(F.col("url"))["path"]
    wanted: Column = plan.wanted(netloc) if plan.wanted else domain_filter(netloc, plan.allow, plan.deny)
    find_secrets = plan.find_secrets or (lambda df, text: extract_secrets(df, text, plan.rules, plan.engine))
    find_links = plan.find_links or (lambda df, base, text: extract_links(df, base, text, plan.links))

    def allowed(urls: DataFrame) -> DataFrame:
        """Distinct urls that may be visited."""
        own = urls.select("url").filter(wanted).distinct()
        return own if plan.denied is None else by_globs(own.withColumn("_name", host_port(netloc)["host"]), "_name", plan.denied, deny=True).drop("_name")

    frontier = cut(allowed(seeds.select(strip(F.col("url")).alias("url")).filter("url != ''")).withColumn("depth", F.lit(0)), "frontier")
    visited = frontier
    nodes: list[DataFrame] = []
    edges: list[DataFrame] = []
    findings: list[DataFrame] = []
    pages, depth = 0, 0
    while not frontier.isEmpty() and (plan.max_depth <= 0 or depth <= plan.max_depth):
        safe = frontier.filter(~is_dangerous(path, plan.dangerous))
        left = plan.max_pages - pages if plan.max_pages > 0 else None
        chosen = cut(capped(safe, left), "chosen")
        pages += chosen.count()
        got = fetch(chosen.select("url"))
        length = F.coalesce(F.col("content_length").try_cast("int"), F.lit(-1))
        fetched = cut(chosen.join(got, "url", "left").withColumn("content_length", length), "fetched")
        body = F.coalesce(F.col("body"), F.lit(""))
        ok = F.col("status").isNotNull()
        nodes.append(fetched.select("url", "depth", F.coalesce("status", F.lit("Unknown")).alias("status"), "content_length", F.coalesce("content_type", F.lit("")).alias("content_type"), titles(body).alias("title"), ok.alias("fetched")))
        live = fetched.filter(ok).select("url", "content_type", body.alias("body"))
        findings.append(cut(find_secrets(live.select("url", "body"), "body"), "findings"))
        texts = live.filter(links_wanted(F.col("content_type"))).select(F.col("url").alias("parent"), "body")
        linked = find_links(texts, "parent", "body").select("parent", F.col("url").alias("child"), "kind").distinct()
        found = cut(linked if plan.append is None else linked.filter(plan.append(F.col("parent"), F.col("child"), F.col("kind"))), "edges")
        edges.append(found)
        if left is not None and pages >= plan.max_pages:
            break
        depth += 1
        frontier = cut(frontier_after(allowed(found.select(F.col("child").alias("url"))), visited).withColumn("depth", F.lit(depth)), "frontier")
        drop(chosen)
        visited = visited.union(frontier)
    spark = seeds.sparkSession
    empty_edges = spark.createDataFrame([], "parent string, child string, kind string")
    empty_nodes = spark.createDataFrame([], "url string, depth int, status string, content_length int, content_type string, title string, fetched boolean")
    all_edges = _all(edges, empty_edges)
    seen = _all(nodes, empty_nodes)
    others = all_edges.select(F.col("child").alias("url")).distinct().join(seen, "url", "left_anti")
    unknown = others.select("url", F.lit(None).cast("int").alias("depth"), F.lit("Unknown").alias("status"), F.lit(-1).alias("content_length"), F.lit("").alias("content_type"), F.lit("").alias("title"), F.lit(False).alias("fetched"))
    found = _all(findings, spark.createDataFrame([], "url string, type string, data string"))
    return CrawlResult(seen.union(unknown), all_edges, found, seen.filter("fetched").select("url"), pages)


def _all(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = empty
    for p in parts:
        out = out.union(p)
    return out


def validate(nodes: DataFrame, fetch: Fetch, by: str = "url") -> DataFrame:
    """nodes with the status of a new fetch where it was not all digits; a fetch that fails changes nothing.

    Nodes of one url share its answer; where each has its own, by is the column that tells their requests apart, and fetch takes and gives it in place of url.
    """
    unknown = unknown_status(F.col("status"))
    targets = nodes.filter(unknown).select(by).distinct()
    fresh = fetch(targets).select(by, F.col("status").alias("_status"))
    return nodes.join(fresh, by, "left").withColumn("status", F.when(unknown, F.coalesce("_status", "status")).otherwise(F.col("status"))).drop("_status")

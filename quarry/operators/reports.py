"""Grouped reports over nodes, edges and findings, as DataFrames and as text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.status import status_allowed
from quarry.functions.urls import host_port, root_domain, url_parts
from quarry.operators.suffixes import with_suffix

Ranges = list[tuple[int, int]] | None


def secret_text(kind: str = "type", data: str = "data") -> Column:
    return F.concat_ws(": ", F.col(kind), F.col(data))


def secrets_by(findings: DataFrame, key: str) -> DataFrame:
    """(key, n, secrets): distinct `type: data` of each key, sorted, a line each."""
    each = findings.select(key, secret_text().alias("s")).distinct()
    return each.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_list("s")), "\n").alias("secrets"))


def format_node(url: Column, status: Column, length: Column, kind: Column, title: Column) -> Column:
    """One line about a page; the length only if it is over 0."""
    size = F.when(length > 0, length.cast("string")).otherwise("")
    return F.concat(url, F.lit(" ["), status, F.lit("] [Content-Length: "), size, F.lit("] [Content-Type: "), F.coalesce(kind, F.lit("")), F.lit("] [Title: "), F.coalesce(title, F.lit("")), F.lit("]"))


def _formatted(nodes: DataFrame, ranges: Ranges) -> DataFrame:
    line = format_node(F.col("url"), F.col("status"), F.col("content_length"), F.col("content_type"), F.col("title"))
    return nodes.withColumn("shown", status_allowed(F.col("status"), ranges)).withColumn("line", line)


def children_by_parent(edges: DataFrame, nodes: DataFrame, kind: str = "url", ranges: Ranges = None) -> DataFrame:
    """(parent, n, lines): distinct lines of the children of a kind that the status filter shows; parents stay with 0."""
    child = _formatted(nodes, ranges).select(F.col("url").alias("child"), "shown", "line")
    each = edges.filter(F.col("kind") == kind).join(child, "child", "left").select("parent", F.when(F.col("shown"), F.col("line")).alias("line")).distinct()
    return each.groupBy("parent").agg(F.count("line").alias("n"), F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("lines"))


def with_domain(urls: DataFrame, url: str, out: str, rules: DataFrame | None = None) -> DataFrame:
    """urls with the registered domain of each url: by suffix rules if there are some (see suffixes), else by the common suffixes of two labels."""
    host = host_port(url_parts(F.col(url))["netloc"])["host"]
    if rules is None:
        return urls.withColumn(out, root_domain(host))
    return with_suffix(urls.withColumn("_host", host), "_host", rules, "_suffix", out).drop("_host", "_suffix")


def urls_per_domain(edges: DataFrame, nodes: DataFrame, seeds: DataFrame, kind: str = "url", ranges: Ranges = None, rules: DataFrame | None = None) -> DataFrame:
    """(bucket, line): distinct lines by registered domain of the seeds, Other for the rest; a bucket of which the status filter shows nothing has one row without
    a line. A row for each line, as Other may hold most of a crawl."""
    roots = with_domain(seeds.select("url"), "url", "bucket", rules).select("bucket").distinct().withColumn("known", F.lit(True))
    own = edges.filter(F.col("kind") == kind)
    urls = own.select(F.col("child").alias("url")).union(own.select("parent")).distinct()
    placed = with_domain(urls, "url", "bucket", rules).join(roots, "bucket", "left").withColumn("bucket", F.when(F.col("known"), F.col("bucket")).otherwise("Other"))
    lines = placed.join(_formatted(nodes, ranges).select("url", "shown", "line"), "url", "left").select("bucket", F.when(F.col("shown"), F.col("line")).alias("line")).distinct()
    shown = lines.filter("line is not null")
    empty = lines.select("bucket").distinct().join(shown.select("bucket").distinct(), "bucket", "left_anti")
    return shown.union(empty.withColumn("line", F.lit(None).cast("string")))


def domain_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n): how many lines each bucket of urls_per_domain has."""
    return rows.groupBy("bucket").agg(F.count("line").alias("n"))


def seed_domains(seeds: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(domain, n): the registered domains of the seeds, and how many seeds each has."""
    return with_domain(seeds.select("url"), "url", "domain", rules).groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def found_domains(edges: DataFrame) -> DataFrame:
    """Distinct hosts, with ports, of everything found."""
    return edges.select(url_parts(F.col("child"))["netloc"].alias("netloc")).distinct()


def summary(pages: DataFrame, edges: DataFrame, visited: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: pages fetched, urls found, urls visited, distinct secrets."""
    one = lambda d, n: d.agg(F.count(F.lit(1)).alias(n))
    out = one(pages, "pages").join(one(edges.select("child").distinct(), "found")).join(one(visited.select("url").distinct(), "visited"))
    return out.join(one(findings.distinct(), "secrets"))


def csv_rows(nodes: DataFrame, edges: DataFrame, findings: DataFrame, fetched: DataFrame) -> DataFrame:
    """Rows of the CSV report: parents and children of url edges and fetched pages, each once, with its secrets a line each. Pages that were not fetched have none."""
    own = edges.filter("kind = 'url'")
    wanted = own.select(F.col("parent").alias("url")).union(own.select("child")).union(fetched.select("url")).distinct()
    lines = secrets_by(findings, "url").select("url", "secrets")
    joined = wanted.join(nodes.dropDuplicates(["url"]), "url", "left").join(lines, "url", "left")
    return joined.select(
        F.col("url").alias("URL"), F.coalesce("title", F.lit("")).alias("Title"), F.coalesce("status", F.lit("Unknown")).alias("Response Code"),
        F.coalesce("content_length", F.lit(-1)).alias("Content Length"), F.coalesce("content_type", F.lit("")).alias("Content Type"), F.coalesce("secrets", F.lit("")).alias("Secrets"),
    )


def with_node(grouped: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Groups by url with the status and depth of the page."""
    about = nodes.dropDuplicates(["url"]).select(F.col("url").alias(key), "status", "depth")
    return grouped.join(about, key, "left")


def report_pieces(grouped: DataFrame, head: str, key: str, lines: str, empty: str = "", depth: bool = False) -> Iterator[str]:
    """text_report a group at a time."""
    none = True
    for row in grouped.orderBy(key).toLocalIterator():
        none = False
        status = f" [{row['status'] or 'Unknown'}]" if "status" in grouped.columns else ""
        yield f"\n{row['n']} {head} {row[key]}{status}{f' (depth:{row['depth']})' if depth else ''}:\n{row[lines]}\n"
    if none:
        yield empty


def text_report(grouped: DataFrame, head: str, key: str, lines: str, empty: str = "", depth: bool = False) -> str:
    """Groups as text: `n head key [status] (depth:d):`, of which status and depth are there if the groups have them, and the lines. Groups come to the driver one after another, sorted."""
    return "".join(report_pieces(grouped, head, key, lines, empty, depth))


def domain_report(rows: DataFrame, head: str) -> str:
    """urls_per_domain as text, Other last. Lines come to the driver one after another, sorted; counts are one for each registered domain of the seeds."""
    counts = {r["bucket"]: r["n"] for r in domain_counts(rows).collect()}
    out, before = [], None
    for row in rows.orderBy(F.col("bucket") == "Other", "bucket", "line").toLocalIterator():
        if row["bucket"] != before:
            out.append(("\n" if out else "") + f"\n{counts[row['bucket']]} {head} {row['bucket']}:")
            before = row["bucket"]
        out.append(f"\n{row['line'] or ''}")
    return "".join(out) + ("\n" if out else "")

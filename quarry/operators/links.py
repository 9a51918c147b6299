"""Links of pages: by patterns and from the DOM, filtered, resolved against the page, classified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.patterns import UNICODE
from quarry.functions.urls import is_static, link_kind, sanitize_url, url_join, url_parts
from quarry.operators.dom import html_references
from quarry.operators.extract import extract_secrets
from quarry.rules import Rule, link_rules
from quarry.schemas import URL_PARTS


def _usable(parts: Column, raw: Column) -> Column:
    """Non-empty links that are no static resource and pass sanitising; the cleaned form is not used further."""
    return (raw != "") & ~is_static(parts["path"]) & (sanitize_url(raw) != "")


def resolve_pattern_link(parts: Column, base: Column) -> Column:
    """Parts of a link found by a pattern: scheme of the page unless http or https, host of the page if it has none. The page's path does not count."""
    return F.struct(
        F.when(parts["scheme"].isin("http", "https"), parts["scheme"]).otherwise(base["scheme"]).alias("scheme"),
        F.when(parts["netloc"] != "", parts["netloc"]).otherwise(base["netloc"]).alias("netloc"),
        *(parts[n].alias(n) for n in URL_PARTS[2:]),
    )


def resolve_dom_link(parts: Column, base: Column) -> Column:
    """Parts of a link found in the DOM: as it is with scheme and host, else with both of the page."""
    full = (parts["scheme"] != "") & (parts["netloc"] != "")
    return F.struct(
        F.when(full, parts["scheme"]).otherwise(base["scheme"]).alias("scheme"),
        F.when(full, parts["netloc"]).otherwise(base["netloc"]).alias("netloc"),
        *(parts[n].alias(n) for n in URL_PARTS[2:]),
    )


def _resolved(df: DataFrame, base: str, raw: str, resolve) -> DataFrame:
    kept = [c for c in df.columns if c not in (base, raw)]
    step = df.withColumn("_parts", url_parts(F.col(raw))).filter(_usable(F.col("_parts"), F.col(raw)))
    step = step.withColumn("parts", resolve(F.col("_parts"), url_parts(F.col(base))))
    return step.select(*kept, base, "parts", url_join(F.col("parts")).alias("url"), link_kind(F.col("parts.path")).alias("kind")).distinct()


def pattern_links(df: DataFrame, base: str, text: str, rules: list[Rule] | None = None, dialect: str = UNICODE) -> DataFrame:
    """Distinct links (other columns, base, parts, url, kind) that the link rules find in a text."""
    found = extract_secrets(df, text, link_rules() if rules is None else rules, "groups", dialect)
    return _resolved(found.drop("type"), base, "data", resolve_pattern_link)


def dom_links(df: DataFrame, base: str, html: str) -> DataFrame:
    """Distinct links (other columns, base, parts, url, kind) of a page's elements."""
    return _resolved(html_references(df, html, "data"), base, "data", resolve_dom_link)


def extract_links(df: DataFrame, base: str, text: str, rules: list[Rule] | None = None, dialect: str = UNICODE) -> DataFrame:
    """Links by patterns and from the DOM together; a link is its six parts, so `a` and `/a` are two."""
    return pattern_links(df, base, text, rules, dialect).union(dom_links(df, base, text)).distinct()

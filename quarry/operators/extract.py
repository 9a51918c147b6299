"""Secrets by rules: every rule over every text, as one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.errors import HandlerError
from quarry.functions.patterns import UNICODE, required
from quarry.functions.text import strip, unescape
from quarry.operators.multiscan import scan_secrets
from quarry.rules import Rule

ENGINES = ("groups", "first", "whole", "scan")


def secrets_column(text: Column, rules: list[Rule], engine: str = "groups", dialect: str = UNICODE) -> Column:
    """array<struct<type, data>> of the distinct secrets of a text, in order of the rules.

    groups: all matches, the first group if there are groups (an unmatched group gives an empty string); first: the first match of each rule,
    whole; whole: all matches, whole, which is what a multi-pattern scanner without groups reports. The engine scan gives what whole does, but is no column: see extract_secrets.
    """
    if engine not in ENGINES or engine == "scan":
        raise HandlerError(f"no such engine: {engine!r}; there are {', '.join(ENGINES[:3])}")
    parts = []
    for rule in rules:
        pattern = dialect + rule.regex
        if engine == "first":
            found = F.when(text.rlike(pattern), F.array(F.regexp_extract(text, pattern, 0))).otherwise(F.array().cast("array<string>"))
        else:
            found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if engine == "groups" and rule.groups else 0))
        parts.append(F.transform(_where_possible(text, rule, found, F.array().cast("array<string>")), _typed(rule.name)))
    if not parts:
        return F.array().cast("array<struct<type:string,data:string>>")
    return F.array_distinct(F.coalesce(F.concat(*parts), F.array().cast("array<struct<type:string,data:string>>")))


def _where_possible(text: Column, rule: Rule, found: Column, none: Column) -> Column:
    """found, worked out only for texts that hold what each match of the rule must hold."""
    literal = required(rule.regex)
    return F.when(F.contains(text, F.lit(literal)), found).otherwise(none) if literal else found


def _typed(name: str):
    return lambda value: F.struct(F.lit(name).alias("type"), value.alias("data"))


def extract_secrets(df: DataFrame, text: str, rules: list[Rule], engine: str = "groups", dialect: str = UNICODE) -> DataFrame:
    """A row (all columns but the text, type, data) for each distinct secret of a text. No shuffle: texts are taken apart where they are.

    engine: as for secrets_column, or scan, which names the rules that a text may match in one walk through it: for packs of hundreds of rules.
    """
    if engine == "scan":
        return scan_secrets(df, text, rules, dialect)
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, F.explode(secrets_column(F.col(text), rules, engine, dialect)).alias("_s")).select(*kept, "_s.type", "_s.data")


def rule_hits(df: DataFrame, text: str, rules: list[Rule], dialect: str = UNICODE) -> DataFrame:
    """(name, hits, texts) of every rule: matches, and texts with one. One pass over the texts; rules without a hit count 0."""
    counts = [_where_possible(F.col(text), r, F.regexp_count(F.col(text), F.lit(dialect + r.regex)), F.lit(0)) for r in rules]
    sums = df.select(*(F.coalesce(c, F.lit(0)).alias(f"_{i}") for i, c in enumerate(counts))).agg(
        *(F.coalesce(F.sum(f"_{i}"), F.lit(0)).alias(f"h{i}") for i in range(len(rules))), *(F.count_if(F.col(f"_{i}") > 0).alias(f"t{i}") for i in range(len(rules)))
    )
    rows = F.array(*(F.struct(F.lit(r.name).alias("name"), F.col(f"h{i}").alias("hits"), F.col(f"t{i}").alias("texts")) for i, r in enumerate(rules)))
    return sums.select(F.inline(rows))


def titles(html: Column) -> Column:
    """All titles of a page, on one line each, without white space at their ends, joined by a bar; entities are resolved."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<title(?:\s[^>]*)?>(.*?)</title>"), F.lit(1))
    return F.array_join(F.transform(found, lambda t: strip(F.regexp_replace(unescape(t), r"[\r\n]", " "))), "|")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))

"""Predicates over hosts, paths and statuses, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.patterns import glob_to_regex
from quarry.functions.urls import host_port
from quarry.operators.extract import any_of


def domain_allowed(netloc: Column, globs: list[str]) -> Column:
    """Whether the host matches any of the shell patterns; case counts."""
    host = host_port(netloc)["host"]
    return any_of([host.rlike(glob_to_regex(g)) for g in globs])


def domain_not_denied(netloc: Column, globs: list[str]) -> Column:
    """Whether the host matches none of the shell patterns."""
    return ~domain_allowed(netloc, globs)


def chain(*conditions: Column) -> Column:
    """All conditions; true if there are none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def domain_filter(netloc: Column, allow: str | None, deny: str | None) -> Column:
    """The filter that the options -d and -D give. Without -D the pattern list holds the empty pattern, which denies hosts that cannot be read."""
    denied = domain_not_denied(netloc, (deny or "").split(","))
    return chain(domain_allowed(netloc, allow.split(",")), denied) if allow else denied


def is_dangerous(path: Column, words: list[str]) -> Column:
    """Whether a path has one of the words, which are patterns, anywhere; case does not count."""
    return any_of([F.trim(path).rlike(f"(?i)/?{w}") for w in words])

"""Predicates by their truth tables."""

import fnmatch
import re

import pytest
from pyspark.sql import functions as F

from quarry.errors import ConfigError
from quarry.functions.patterns import glob_to_regex
from quarry.functions.status import links_wanted, parse_status, status_allowed, status_class, unknown_status
from quarry.operators import filters


def values(spark, given, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v string").select("i", make(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(rows, key=lambda r: r["i"])]


HOSTS = ["www.example.com", "example.com", "a.b.example.com", "example.org", "Example.com", "", "e[x].com", "a-b.com"]


@pytest.mark.parametrize("glob", ["*.example.com", "example.*", "*", "", "?xample.com", "[a-e]xample.com", "[!e]*.com", "*.com", "e[[]x].com", "a-b.c?m", "[!]x]*", "[^e]*"])
def test_globs(glob):
    for host in HOSTS:
        assert bool(re.search(glob_to_regex(glob).replace(r"\z", r"\Z"), host)) == fnmatch.fnmatchcase(host, glob), (glob, host)


def test_domain_filters(spark):
    allow, deny = ["*.example.com"], ["b.*"]
    hosts = ["a.example.com", "b.example.com", "example.com", "a.example.org", "a.example.com:8080", "x:y:z"]
    assert values(spark, hosts, lambda h: filters.domain_allowed(h, allow)) == [True, True, False, False, True, False]
    assert values(spark, hosts, lambda h: filters.domain_filter(h, "*.example.com", "b.*")) == [True, False, False, False, True, False]
    assert values(spark, hosts, lambda h: filters.domain_not_denied(h, deny)) == [True, False, True, True, True, True]
    # Without -D, hosts that cannot be read are denied.
    assert values(spark, hosts, lambda h: filters.domain_filter(h, None, None)) == [True] * 5 + [False]
    assert values(spark, ["x"], lambda h: filters.chain()) == [True]


def test_dangerous_paths(spark):
    assert values(spark, ["/Logout", "/x/deleteAll", "/a", " /update ", ""], lambda p: filters.is_dangerous(p, ["logout", "update", "delete"])) == [True, True, False, True, False]


def test_content_types(spark):
    kinds = ["text/html; charset=utf-8", "application/json", "application/pdf", "application/octet-stream", "image/png", None, " TEXT/plain"]
    assert values(spark, kinds, links_wanted) == [True, True, False, False, False, False, True]


def test_status(spark):
    given = ["200", "302", "500", "404", "Unknown", "201", None]
    assert values(spark, given, lambda s: status_allowed(s, None)) == [True, True, True, False, True, True, True]
    assert values(spark, given, lambda s: status_allowed(s, [(200, 201), (300, 400)])) == [True, True, False, False, False, False, False]
    assert values(spark, given, lambda s: status_allowed(s, [(404, 405)])) == [False] * 7
    assert values(spark, given, status_class) == ["green", "yellow", "red", "magenta", "Unknown", "red", None]
    assert values(spark, given, unknown_status) == [False, False, False, False, True, False, True]


def test_status_option():
    assert parse_status("200,300-400") == [(200, 201), (300, 401)]
    for bad in ("x", "400-300", "99-100", "200-"):
        with pytest.raises(ConfigError):
            parse_status(bad)

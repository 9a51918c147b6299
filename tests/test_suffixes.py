"""Suffix rules against the rules read one by one."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.errors import ConfigError
from quarry.operators import reports, suffixes

FILE = """// a list
com
// of rules
uk
co.uk
  k12.ca.us   and a remark

US
ca.us
*.ck
!www.ck
*.kawasaki.jp
!city.kawasaki.jp
jp
*.b.c.d
c.d
// ===BEGIN PRIVATE DOMAINS===
blogs.com
"""
HOSTS = ["a.com", "com", "x.y.co.uk", "co.uk", "uk", "X.Y.Co.UK", "p.k12.ca.us", "k12.ca.us", "ca.us", "z.us", "ck", "x.ck", "a.x.ck", "www.ck", "a.www.ck", "q.kawasaki.jp", "p.q.kawasaki.jp", "city.kawasaki.jp", "a.city.kawasaki.jp", "kawasaki.jp",
    "e.b.c.d", "f.e.b.c.d", "b.c.d", "c.d", "d", "x.d", "localhost", "127.0.0.1", "a.unknown", "", None, "me.blogs.com", "a.com.", "..", "a..com", ".com"]


def plain(host, rules):
    """(suffix, registered) by trying every rule."""
    if host is None:
        return None, None
    host = host.removesuffix(".")
    labels = [host] if host.replace(".", "").isdigit() and host.count(".") == 3 else host.split(".")
    low, best = [x.lower() for x in labels], 0
    for rule in rules:
        parts = rule.lstrip("!").split(".")
        if len(parts) <= len(low) and all(p in ("*", x) for p, x in zip(parts[::-1], low[::-1], strict=False)):
            if rule.startswith("!"):
                best = len(parts) - 1
                break
            best = max(best, len(parts))
    if not best:
        return "", labels[-1] + "."
    own = ".".join(labels[-best:])
    return own, "." + own if best >= len(labels) else ".".join(labels[-best - 1 :])


def check(spark, hosts, rules, table):
    df = spark.createDataFrame([(i, h, "kept") for i, h in enumerate(hosts)], "depth int, host string, node string")
    got = suffixes.with_suffix(df, "host", table).orderBy("depth").collect()
    ordered = sorted(rules, key=lambda r: (not r.startswith("!"), -r.count(".")))
    assert [(r["host"], r["suffix"], r["root"]) for r in got] == [(h, *plain(h, ordered)) for h in hosts]
    assert all(r["node"] == "kept" for r in got)


@pytest.mark.parametrize("private", [False, True])
def test_hosts(spark, tmp_path, private):
    (tmp_path / "rules").write_text(FILE)
    table = suffixes.read_suffix_rules(spark, f"file://{tmp_path}/rules", private)
    rules = {r["rule"] for r in table.collect()}
    assert rules == {"com", "uk", "co.uk", "k12.ca.us", "us", "ca.us", "*.ck", "!www.ck", "*.kawasaki.jp", "!city.kawasaki.jp", "jp", "*.b.c.d", "c.d"} | ({"blogs.com"} if private else set())
    check(spark, HOSTS, rules, table)


def test_random_hosts_and_tables_too_large_to_broadcast(spark, monkeypatch):
    rng = random.Random(3)
    name = lambda n: ".".join(rng.choice("abc") for _ in range(n))
    rules = {name(rng.randint(1, 4)) for _ in range(25)} | {"*." + name(rng.randint(1, 3)) for _ in range(6)}
    rules |= {"!" + name(1) + r[1:] for r in sorted(rules) if r.startswith("*")}
    table = spark.createDataFrame([(r,) for r in sorted(rules)], "rule string")
    hosts = [name(rng.randint(1, 6)) for _ in range(500)]
    check(spark, hosts, rules, table)
    monkeypatch.setattr(suffixes, "BROADCAST_NODES", 0)
    check(spark, hosts[:100], rules, table)


def test_no_rules_and_wildcards_inside(spark):
    none = spark.createDataFrame([], "rule string")
    check(spark, ["a.b", "x", None], set(), none)
    with pytest.raises(ConfigError):
        suffixes.with_suffix(spark.createDataFrame([("a.b",)], "host string"), "host", spark.createDataFrame([("a.*.b",)], "rule string"))


def test_small_rules_are_looked_up_without_a_shuffle_of_hosts(spark):
    hosts = spark.range(1000).select(F.concat(F.col("id"), F.lit(".co.uk")).alias("host"))
    found = suffixes.with_suffix(hosts, "host", spark.createDataFrame([("co.uk",), ("uk",)], "rule string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert found.filter("root != host").isEmpty()


def test_reports_by_suffix_rules(spark):
    """Two names under a suffix of two labels are two domains once the rules say so."""
    nodes = spark.createDataFrame([(f"http://{h}/", "200", -1, "", "") for h in ("x.hosting.org", "y.hosting.org", "z.other.net")], "url string, status string, content_length int, content_type string, title string")
    edges = spark.createDataFrame([("http://x.hosting.org/", "http://y.hosting.org/", "url"), ("http://x.hosting.org/", "http://z.other.net/", "url")], "parent string, child string, kind string")
    seeds = spark.createDataFrame([("http://x.hosting.org/",)], "url string")
    rules = spark.createDataFrame([("org",), ("hosting.org",)], "rule string")
    buckets = lambda r: {(x["bucket"], (x["line"] or "").split(" ")[0]) for x in reports.urls_per_domain(edges, nodes, seeds, rules=r).collect()}
    assert buckets(None) == {("hosting.org", "http://x.hosting.org/"), ("hosting.org", "http://y.hosting.org/"), ("Other", "http://z.other.net/")}
    assert buckets(rules) == {("x.hosting.org", "http://x.hosting.org/"), ("Other", "http://y.hosting.org/"), ("Other", "http://z.other.net/")}
    assert [tuple(r) for r in reports.seed_domains(seeds, rules).collect()] == [("x.hosting.org", 1)]

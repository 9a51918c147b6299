"""Tables of globs and ranges against trying each one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.errors import ConfigError
from quarry.functions.patterns import glob_to_regex
from quarry.operators import tables

GLOBS = ["*.example.com", "m.*", "blog.*", "*.th??th*.org", "spam-farm.[!a-d]xample.org", "exact.host", "*ample.net", "*", "", "?", "a.*.com", "*deny*", "[ab].c", "x[.]y.com", "*.", ".*", "*.b", "[]a]b*.q.r", "no[", "é*.fr", "*.É.fr"]


def hosts_of(rng, n):
    parts = ["example", "com", "m", "blog", "thxxth", "org", "net", "a", "b", "deny", "xdenyx", "spam-farm", "É", "fr", "exact", "host", "sample", "q", "r", "]b", ""]
    return [".".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n)] + ["exact.host", "spam-farm.example.org", "spam-farm.axample.org", "x.y.com", None, "", "a", "no["]


@pytest.mark.parametrize("seed", range(3))
def test_globs(spark, seed):
    rng = random.Random(seed)
    hosts = hosts_of(rng, 300) + ["m.hot"] * 50
    df = spark.createDataFrame([(i, h, "k") for i, h in enumerate(hosts)], "i int, h string, host string")
    for globs in ([g for g in GLOBS if g != "*"], rng.sample(GLOBS, 4), [g for g in GLOBS if tables.glob_keys(g)[:1] > ["."] and tables.glob_keys(g)[0][0] == "."], ["*"], [None], []):
        hit = {i for i, h in enumerate(hosts) if h is not None and any(re.match(glob_to_regex(g).replace(r"\z", r"\Z"), h) for g in globs if g is not None)}
        table = spark.createDataFrame([(g,) for g in globs] * 2, "glob string")
        assert {r["i"] for r in tables.by_globs(df, "h", table).collect()} == hit
        assert sorted(r["i"] for r in tables.by_globs(df, "h", table, deny=True).collect()) == sorted(set(range(len(hosts))) - hit)


def test_keys():
    known = {"*.example.com": [".example.com"], "*ample.net": [".net"], "m.*": [], "blog.*": ["+blog."], "exact.host": ["=exact.host"], "*": [], "*.": [], "a*.b.c": [".b.c"], "[.]x.y": [".y"], "x.[ab]": [], "*deny1234-*": ["+deny1234", "+eny1234-"]}
    assert {g: tables.glob_keys(g) for g in known} == known


def test_a_hundred_thousand_globs(spark):
    """Many patterns of all kinds, and no join that compares all with all."""
    n = 100_000
    globs = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.concat(F.lit("*.d"), F.col("id"), F.lit(".net"))).otherwise(F.concat(F.lit("*ban"), F.col("id"), F.lit(".*"))).alias("glob"))
    hosts = spark.range(2000).select(F.expr("case id % 4 when 0 then concat('a.d', id * 2, '.net') when 1 then concat('a.d', id, '.net') when 2 then concat('x-ban', id + 1, '.x') else concat('x.bann', id, '.y') end").alias("h"))
    left = tables.by_globs(hosts, "h", globs, deny=True)
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(r["h"] for r in left.collect()) == sorted(f"a.d{i}.net" if i % 4 == 1 else f"x.bann{i}.y" for i in range(2000) if i % 2)


def test_too_many_bare_globs(spark, monkeypatch):
    monkeypatch.setattr(tables, "BARE", 2)
    with pytest.raises(ConfigError):
        tables.by_globs(spark.createDataFrame([("a",)], "h string"), "h", spark.createDataFrame([("*",), ("?",), ("a*",)], "glob string"))


@pytest.mark.parametrize("seed", range(3))
def test_ranges(spark, seed):
    rng = random.Random(seed)
    far = 2**63 - 1
    ranges = [(a, a + rng.choice([0, 1, 2, 3, 100, 10**6, 2**40])) for a in (rng.randrange(-(10**4), 10**4) for _ in range(30))]
    ranges += [[(200, 300), (far - 1, far), (None, 5), (5, None), (9, 3)], [(-(2**63), -(2**62)), (400, 401)], [(-(2**63), far)]][seed]
    ranges = ranges if seed < 2 else ranges[:5] + ranges[-1:]
    values = [rng.randrange(-(10**5), 10**5) for _ in range(300)] + [None, far, far - 1, -(2**63), 0] + [200] * 40
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "_low int, v long")
    hit = {i for i, v in enumerate(values) if v is not None and any(a is not None and b is not None and a <= v < b for a, b in ranges)}
    table = spark.createDataFrame(ranges, "low long, high long")
    inside = tables.by_ranges(df, "v", table)
    assert {r["_low"] for r in inside.collect()} == hit and "NestedLoop" not in inside._jdf.queryExecution().executedPlan().toString()
    assert sorted(r["_low"] for r in tables.by_ranges(df, "v", table, outside=True).collect()) == sorted(set(range(len(values))) - hit)
    none = table.limit(0)
    assert tables.by_ranges(df, "v", none).count() == 0 and tables.by_ranges(df, "v", none, outside=True).count() == len(values)

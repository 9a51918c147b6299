"""Registered domains by public suffix rules: exact, wildcard and exception rules, the longest of which counts.

Rules become the nodes of a trie over labels from the last one on: a node, named by its labels, says whether a rule ends there, any label below it is a suffix, or it is
an exception. A host asks for one node for each label of its name, deepest first: as many lookups as the deepest rule has labels, each a join with the table of nodes, which is broadcast
while it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import ConfigError
from quarry.functions.text import strip
from quarry.functions.urls import IP
from quarry.session import cut

#: Nodes that are broadcast at most, about 50 bytes each; larger tables are joined by shuffles.
BROADCAST_NODES = 1 << 18
RULE, WILDCARD, EXCEPTION = 1, 2, 4
PRIVATE = "===BEGIN PRIVATE DOMAINS==="


def read_suffix_rules(spark: SparkSession, path: str, private: bool = False) -> DataFrame:
    """(rule) of a file with one rule a line, of any filesystem: what stands behind a space, blank lines and lines that begin with // do not count.

    Rules behind the line that begins the private domains, if there is one, are those of companies, and are left out unless asked for.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("value") if private else F.split_part("value", F.lit(PRIVATE), F.lit(1)).alias("value"))
    lines = whole.select(F.explode(F.split("value", r"\R")).alias("line"))
    rules = lines.select(F.lower(F.split(strip(F.col("line")), r"\s").getItem(0)).alias("rule"))
    return rules.filter("rule != '' and not startswith(rule, '//')").distinct()


def suffix_nodes(rules: DataFrame) -> DataFrame:
    """(node, depth, marks): the nodes of the trie at which something is decided; marks adds RULE, WILDCARD (below the node) and EXCEPTION."""
    text = F.regexp_replace("rule", r"^\.|\.$", "")
    kind = F.when(F.startswith(text, F.lit("!")), EXCEPTION).when(F.startswith(text, F.lit("*.")), WILDCARD).otherwise(RULE)
    each = rules.select(F.regexp_replace(text, r"^(!|\*\.)", "").alias("node"), kind.alias("_m")).filter("node != '' and node != '*'")
    each = each.withColumn("node", F.lower("node"))
    return each.groupBy("node").agg(F.bit_or("_m").alias("marks")).select("node", F.size(F.split("node", r"\.", -1)).alias("depth"), "marks")


def with_suffix(df: DataFrame, host: str, rules: DataFrame, suffix: str = "suffix", root: str = "root") -> DataFrame:
    """df with the public suffix of a host, and its registered domain: the label before the suffix, a dot, the suffix.

    A host's longest exception rule counts first, without its first label, else the longest rule; without a rule the suffix is empty and the name is the last label; an address is a name.
    A host that is itself a suffix has no name before the dot. Hosts compare without case and keep theirs; a dot at the end does not count; a null host has nulls.
    """
    nodes = cut(suffix_nodes(rules), "suffixes")
    n, deepest, inner = nodes.agg(F.count(F.lit(1)), F.coalesce(F.max("depth"), F.lit(0)), F.max(F.when(F.contains("node", F.lit("*")), F.col("node")))).first()
    if inner:
        raise ConfigError(f"a wildcard inside a rule: {inner}")
    small = F.broadcast if n <= BROADCAST_NODES else lambda d: d
    last = lambda k: F.array_join(F.slice("_labels", -k, k), ".")
    name = F.regexp_replace(F.col(host), r"\.$", "")
    step = df.withColumn("_labels", F.when(name.rlike(IP), F.array(name)).otherwise(F.split(name, r"\.", -1))).withColumn("_n", F.size("_labels"))
    for depth in range(1, deepest + 1):
        own = nodes.filter(F.col("depth") == depth).select(F.col("node").alias("_node"), F.col("marks").alias(f"_m{depth}"))
        key = F.when(F.col("_n") >= depth, F.lower(last(F.lit(depth))))
        step = step.withColumn("_key", key).join(small(own), F.col("_key") == F.col("_node"), "left").drop("_key", "_node")
    step = step.withColumn("_s", _length([F.coalesce(F.col(f"_m{d}"), F.lit(0)) for d in range(1, deepest + 1)], F.col("_n")))
    ruled = F.col("_s") > 0
    own = F.when(ruled, last(F.col("_s"))).otherwise("")
    registered = F.when(~ruled, F.concat(F.element_at("_labels", -1), F.lit("."))).when(F.col("_s") >= F.col("_n"), F.concat(F.lit("."), own)).otherwise(last(F.col("_s") + 1))
    known = F.col(host).isNotNull()
    return step.select(*df.columns, F.when(known, own).alias(suffix), F.when(known, registered).alias(root))


def _length(marks: list[Column], labels: Column) -> Column:
    """How many labels of a host are its public suffix, from the marks of its nodes by depth; 0 without a rule."""
    out = F.lit(0)
    for d, m in enumerate(marks, 1):
        out = F.when((m.bitwiseAND(F.lit(WILDCARD)) != 0) & (labels > d), d + 1).when((m.bitwiseAND(F.lit(RULE)) != 0) & (out < d), d).otherwise(out)
    for d, m in enumerate(marks, 1):
        out = F.when(m.bitwiseAND(F.lit(EXCEPTION)) != 0, d - 1).otherwise(out)
    return out

"""One walk through a text for all rules: an automaton over what their matches must hold names the rules to match.

From each rule come strings of which every match holds at least one, letters included. An Aho-Corasick automaton over all of them, letters folded, meets every text once, so
that a text's cost hardly depends on the number of rules; only the rules it names are matched, by the JVM's patterns as everywhere else.
Rules of which no string is known are matched against all texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.errors import HandlerError
from quarry.functions.patterns import UNICODE, folded, needed
from quarry.functions.text import constant
from quarry.rules import Rule
from quarry.session import ship_package

#: Shorter strings stand nearly everywhere: each is looked for by itself, without naming every place.
SHORT = 3


def candidate_finder(rules: list[Rule]) -> Callable[[str | None], list[int]]:
    """A function from a text to the places of the rules that it may match, in order."""
    import ahocorasick

    always, owners = [], {}
    for i, rule in enumerate(rules):
        strings = needed(rule.regex)
        if not strings:
            always.append(i)
        for s in strings:
            owners.setdefault(s, []).append(i)
    short = {s: own for s, own in owners.items() if len(s) < SHORT}
    automaton = ahocorasick.Automaton()
    for s, own in owners.items():
        if len(s) >= SHORT:
            automaton.add_word(s, tuple(own))
    if len(automaton):
        automaton.make_automaton()

    def find(text: str | None) -> list[int]:
        if text is None:
            return []
        flat = folded(text)
        found = set(always)
        for s, own in short.items():
            if s in flat:
                found.update(own)
        if len(automaton):
            for own in {own for _, own in automaton.iter(flat)}:
                found.update(own)
        return sorted(found)

    return find


def with_candidates(df: DataFrame, text: str, rules: list[Rule], out: str = "candidates") -> DataFrame:
    """df with an array of the places, in the list, of the rules that a text may match; a null text has none. No shuffle."""
    ship_package(df.sparkSession)
    listed = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = candidate_finder(listed)
        for batch in batches:
            found = [find(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def _named(df: DataFrame, text: str, rules: list[Rule], dialect: str) -> tuple[DataFrame, Column]:
    """A row for each text and candidate (_rule), and the matches of that candidate as an array."""
    if len({r.name for r in rules}) < len(rules):
        raise HandlerError("two rules of one name")
    patterns = constant([dialect + r.regex for r in rules], "array<string>")
    each = with_candidates(df, text, rules, "_rules").select(*df.columns, F.explode("_rules").alias("_rule"))
    return each, F.regexp_extract_all(F.col(text), F.get(patterns, F.col("_rule")), F.lit(0))


def scan_secrets(df: DataFrame, text: str, rules: list[Rule], dialect: str = UNICODE) -> DataFrame:
    """A row (all columns but the text, type, data) for each distinct whole match of a rule in a text: the rows of the engine `whole`."""
    kept = [c for c in df.columns if c != text]
    each, found = _named(df, text, rules, dialect)
    names = constant([r.name for r in rules], "array<string>")
    return each.select(*kept, F.get(names, F.col("_rule")).alias("type"), F.explode(F.array_distinct(found)).alias("data"))


def scan_hits(df: DataFrame, text: str, rules: list[Rule], dialect: str = UNICODE) -> DataFrame:
    """(name, hits, texts) of every rule, as rule_hits has them: matches, and texts with one; rules without a hit count 0. Sums before the shuffle."""
    each, found = _named(df.select(text), text, rules, dialect)
    counts = each.select("_rule", F.size(found).alias("_n")).groupBy("_rule").agg(F.sum("_n").alias("hits"), F.count_if(F.col("_n") > 0).alias("texts"))
    names = df.sparkSession.createDataFrame([(i, r.name) for i, r in enumerate(rules)], "_rule int, name string")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return names.join(counts, "_rule", "left").select("name", zero("hits"), zero("texts"))

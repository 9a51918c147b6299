"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws -ln(u) / weight, with u hashed from the key
and the child's name, and the smallest draw wins. A draw depends on nothing but key, name and weight: when a subtree's
weight changes, keys move only into or out of that subtree. A shard added in a region of its own takes keys only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.ranks import gapless_rank


@dataclass(frozen=True)
class Shard:
    """A leaf of the tree."""

    number: int
    region: str
    rack: str
    weight: float = 1.0


def even_tree(shards: int, racks: int = 2, per_rack: int = 4) -> list[Shard]:
    """shards of weight 1, filled rack by rack and region by region."""
    return [Shard(i, f"region{i // (racks * per_rack)}", f"rack{i // per_rack}") for i in range(shards)]


def grown(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """The tree with one more shard, in a region and rack of its own: no weight of another subtree changes."""
    number = 1 + max((s.number for s in tree), default=-1)
    return [*tree, Shard(number, f"added{number}", f"added{number}", weight)]


def _lowest(keys: list[Column], level: str, children: dict[str, float]) -> Column:
    """The name of the child with the lowest draw; ties by name."""
    draws = []
    for name, weight in sorted(children.items()):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(level), F.lit(name), *keys), 11)
        u = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
        draws.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(name).alias("name")))
    return F.array_min(F.array(*draws))["name"] if len(draws) > 1 else F.lit(next(iter(children)))


def shard_of(keys: list[Column], tree: list[Shard]) -> Column:
    """The shard number of a key. Shards of weight 0 or less get nothing; a tree without weight gives null."""
    live = [s for s in tree if s.weight > 0]
    if not live:
        return F.lit(None).cast("int")
    regions: dict[str, dict[str, list[Shard]]] = {}
    for s in live:
        regions.setdefault(s.region, {}).setdefault(s.rack, []).append(s)
    total = lambda shards: sum(s.weight for s in shards)
    region = _lowest(keys, "region", {r: total(s for rack in racks.values() for s in rack) for r, racks in regions.items()})

    def choose(name: Column, options: dict[str, Column]) -> Column:
        (_, first), *rest = options.items()
        return reduce(lambda done, x: F.when(name == x[0], x[1]).otherwise(done), rest, first)

    def in_region(r: str, racks: dict[str, list[Shard]]) -> Column:
        rack = _lowest(keys, f"rack/{r}", {k: total(v) for k, v in racks.items()})
        leaves = {k: _lowest(keys, f"shard/{r}/{k}", {str(s.number): s.weight for s in v}) for k, v in racks.items()}
        return choose(rack, leaves)

    return choose(region, {r: in_region(r, racks) for r, racks in regions.items()}).cast("int")


def shard_documents(df: DataFrame, tree: list[Shard], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, size (UTF-8 bytes + 1), text_crc32, law, shard, slot (gapless from 0 in its shard), grown_shard.

    A null text counts as empty, a null key is a key like another, equal rows get one shard and slots of their
    own, an empty table gives no rows, other columns of df are left out.
    """
    keys = [F.col(key)]
    placed = df.select(
        key,
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(F.col(text), "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(keys, tree).alias("shard"),
        shard_of(keys, grown(tree)).alias("grown_shard"),
    )
    # Slots go by key and text, so that a key of many rows is split.
    ranked = gapless_rank(placed, "shard", [key, "text_crc32", "size"], "slot", counted=placed.select(key, "text_crc32", "size", "shard"))
    return ranked.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")

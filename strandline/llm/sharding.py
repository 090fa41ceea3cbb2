"""Hierarchical weighted hash tree: rows descend region, rack and shard levels.

Every inner node draws, for each row key, one exponential variate per child (minus the
logarithm of a keyed hash, over the child's weight) and the row follows the smallest.
A child is therefore chosen in proportion to its weight, and changing one child's
weight moves rows only into or out of that child: movement stays in the subtrees whose
weights change.  :func:`grow` puts a new shard into a region of its own, so all the
rows that move go to the new shard.

A null key is a key like any other (the hash skips it); equal keys always share a shard, and
repeated rows each get a slot of their own.  Null and empty texts have size 1 and CRC 0;
whole texts are read.  Equal draws go to the smaller node, equal rows of a slot bucket to
either slot.  An empty table gives an empty result.  Further columns are not returned,
and clash with none here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int) -> list[Leaf]:
    """Two shards a rack, two racks a region for the first eight; each further shard has its own region."""
    base = [Leaf(i // 4, i // 2, i) for i in range(min(shards, 8))]
    for _ in range(8, shards):
        base = grow(base)
    return base


def grow(leaves: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """One more shard, in a region and rack of its own."""
    return [
        *leaves,
        Leaf(
            max((x.region for x in leaves), default=-1) + 1,
            max((x.rack for x in leaves), default=-1) + 1,
            max((x.shard for x in leaves), default=-1) + 1,
            weight,
        ),
    ]


def _children(leaves: list[Leaf], parent: str | None, child: str) -> dict[int, dict[int, float]]:
    out: dict[int, dict[int, float]] = {}
    for leaf in leaves:
        if leaf.weight > 0:
            level = out.setdefault(getattr(leaf, parent) if parent else 0, {})
            node = getattr(leaf, child)
            level[node] = level.get(node, 0.0) + leaf.weight
    return out


def _draw(children: dict[int, float], key: list[Column], level: str) -> Column:
    """The child with the smallest draw; ties go to the smaller node number."""
    draws = []
    for node, weight in sorted(children.items()):
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(level), F.lit(node), *key), 11)
        unit = (bits.cast("double") + F.lit(0.5)) / F.lit(float(2**53))
        draws.append(F.struct((-F.log(unit) / F.lit(weight)).alias("draw"), F.lit(node).alias("node")))
    return F.array_min(F.array(*draws))["node"] if len(draws) > 1 else F.lit(next(iter(children)))


def shard_of(leaves: list[Leaf], key: list[Column]) -> Column:
    """The shard of a key: three draws, one a level."""
    if not any(x.weight > 0 for x in leaves):
        raise ValueError("no shard has a weight")
    column = _draw(_children(leaves, None, "region")[0], key, "region")
    for parent, child in (("region", "rack"), ("rack", "shard")):
        chosen = None
        for node, below in sorted(_children(leaves, parent, child).items()):
            option = _draw(below, key, child)
            chosen = F.when(column == node, option) if chosen is None else chosen.when(column == node, option)
        column = chosen
    return column


def with_slots(df: DataFrame, group: str, order: list[str], groups: list[int], buckets: int = 256) -> DataFrame:
    """Adds ``slot``: numbers 0.. without gaps in each group.

    Rows of a group are dealt to ``buckets`` hash buckets and numbered there; the buckets'
    offsets come from a table of at most ``len(groups) * buckets`` rows, which is broadcast.
    No task sees a whole group.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(group, "_bucket").agg(F.count("*").alias("_n")).select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    numbered = bucketed.withColumn("_at", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(offsets), [group, "_bucket"]).withColumn("slot", (F.col("_offset") + F.col("_at")).cast("long")).drop("_bucket", "_at", "_offset")


def assign_shards(df: DataFrame, leaves: list[Leaf], key: str = "doc_id", text: str = "text", grown: list[Leaf] | None = None, slot_buckets: int = 256) -> DataFrame:
    """Shard, slot and size of every row; ``grown`` adds the shard under another tree.

    The text itself is not shuffled: only its byte size and CRC are kept.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    columns = [
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        shard_of(leaves, [F.col(key)]).cast("int").alias("shard"),
        (shard_of(grown, [F.col(key)]) if grown else F.lit(None)).cast("int").alias("grown_shard"),
    ]
    return with_slots(df.select(*columns), "shard", [key, "text_crc32", "size"], [x.shard for x in leaves], slot_buckets)

"""Hierarchical weighted hash tree: documents to shards, with the least movement when the tree changes.

Regions hold racks and racks hold shards; a node weighs what the shards below it weigh together. A key descends from the top: among the
children of its node each draws a waiting time -ln(u) / weight, u hashed from the key and the child's path alone, and the least draw wins,
so that a child is chosen by its share of the weight. Only the children on the key's own path are drawn. As a draw depends on nothing but
the key, the child and the child's weight, a changed weight moves keys only into or out of the subtrees that hold it: no key moves
between two subtrees whose weights stay the same. A shard that is added as a region of its own takes keys only into itself.

Null and repeated keys: a null key is hashed like any other value, equal keys share a shard, each row gets a slot of its own.
Null text has no bytes. An empty table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bound, text_or_empty

SEED = 20_240_917
#: Rows that one slot bucket holds on average, and the least number of buckets of a shard.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 8
#: Buckets over which a repeated row is dealt out at most.
COPIES = 4096


@dataclass(frozen=True)
class Leaf:
    shard: int
    rack: int
    region: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks_per_region: int = 2) -> list[Leaf]:
    """Shards 0 .. n-1 filled into racks and regions in order; where all regions are full, one more shard is a region of its own."""
    return [Leaf(i, i // per_rack, i // (per_rack * racks_per_region)) for i in range(shards)]


def descend(key: Column, tree: Sequence[Leaf]) -> Column:
    """The place of a key: a struct with fields region, rack and shard."""
    levels: dict[int, dict[int, list[Leaf]]] = {}
    for leaf in tree:
        if leaf.weight > 0:
            levels.setdefault(leaf.region, {}).setdefault(leaf.rack, []).append(leaf)

    def node(name: int, weight: float, below: Column | None = None) -> Column:
        own = [F.lit(name).alias("name"), F.lit(float(weight)).alias("weight")]
        return F.struct(*own, *([below.alias("below")] if below is not None else []))

    def rack_node(k: int, leaves: list[Leaf]) -> Column:
        return node(k, sum(x.weight for x in leaves), F.array(*[node(x.shard, x.weight) for x in leaves]))

    def region_node(k: int, racks: dict[int, list[Leaf]]) -> Column:
        return node(k, sum(x.weight for leaves in racks.values() for x in leaves), F.array(*[rack_node(r, x) for r, x in racks.items()]))

    def won(children: Column, *path: Column) -> Column:
        """The child with the least draw."""

        def draw(child: Column, i: Column) -> Column:
            h = F.xxhash64(key, *path, child["name"], F.lit(SEED + len(path)))
            u = (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)
            return F.struct((-F.ln(u) / child["weight"]).alias("draw"), i.alias("i"))

        return F.get(children, F.array_min(F.transform(children, draw))["i"])

    def in_region(region: Column) -> Column:
        return bound(won(region["below"], region["name"]), lambda rack: in_rack(region, rack))

    def in_rack(region: Column, rack: Column) -> Column:
        shard = won(rack["below"], region["name"], rack["name"])["name"]
        return F.struct(region["name"].alias("region"), rack["name"].alias("rack"), shard.alias("shard"))

    return bound(won(F.array(*[region_node(k, racks) for k, racks in levels.items()])), in_region)


def shard_documents(docs: DataFrame, tree: Sequence[Leaf], grown: Sequence[Leaf] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, region and rack.

    Slots count from 0 without gaps in each shard. They come from two levels, so that no task holds a whole shard: rows are numbered
    within hash buckets of a shard, by key and text, and the buckets' counts give the offsets.
    """
    rows = docs.count()  # from the files' footers
    buckets = max(LEAST_BUCKETS, ceil(rows / max(1, len(tree)) / BUCKET_ROWS))
    body = text_or_empty(text)
    spot = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    moved = descend(F.col("doc_id"), grown)["shard"] if grown is not None else F.lit(None).cast("int")
    # Rows with one key share a shard; their texts, and for repeated rows their places in the input's parts, deal them out over its buckets.
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.pmod(F.monotonically_increasing_id(), F.lit(COPIES)), F.lit(SEED + 9)), F.lit(buckets)).cast("int")
    spot = spot.withColumn("spot", descend(F.col("doc_id"), tree)).withColumn("grown_shard", moved).withColumn("bucket", bucket)
    spot = spot.select("*", "spot.region", "spot.rack", "spot.shard").drop("spot")
    counts = spot.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    numbered = spot.withColumn("rank", F.row_number().over(inside) - 1)
    return numbered.join(offsets, ["shard", "bucket"], "left").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("base") + F.col("rank")).cast("long").alias("slot"),
        "grown_shard",
        "region",
        "rack",
    )

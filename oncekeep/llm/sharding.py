"""Sharding by a hierarchical weighted hash tree: region, rack, shard."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import with_positions
from .common import text_of

# Tree[region][rack] is the list of (shard, weight) below it.
Tree = list[list[list[tuple[int, float]]]]


@dataclass(frozen=True)
class Added:
    """A shard added to the tree after the others, where it stands, and its weight."""

    shard: int
    weight: float
    region: int
    rack: int


def even_tree(regions: int = 2, racks: int = 4, shards: int = 5) -> Tree:
    """Equal weights; shards are numbered from 0."""
    number = iter(range(regions * racks * shards))
    return [[[(next(number), 1.0) for _ in range(shards)] for _ in range(racks)] for _ in range(regions)]


def _draw(key: list[Column], node: str, weight: float) -> Column:
    """Arrival time of a node for a key: exponential with the node's weight as its rate."""
    bits = F.shiftrightunsigned(F.xxhash64(*key, F.lit(node)), 11)
    return -F.ln((bits.cast("double") + 0.5) / float(2**53)) / weight


def _first(draws: list[tuple[Column, int]]) -> Column:
    return F.array_min(F.array(*[F.struct(d.alias("at"), F.lit(i).alias("id")) for d, i in draws]))


def _only(draws: list[tuple[Column, int]]) -> list[tuple[Column, int]]:
    if not draws:
        raise ValueError("no node has a positive weight")
    return draws


def assign(df: DataFrame, key: str, tree: Tree, added: list[Added] = (), prefix: str = "") -> DataFrame:
    """Add region, rack and shard (named with ``prefix``), decided by ``key`` and the tree alone.

    At each level every child draws from its own hash with its weight and the earliest draw wins,
    so a node is taken in proportion to its weight. A node's draw depends on its own name and
    weight only: when weights change, only rows that enter or leave a changed subtree move.

    A shard in ``added`` draws at the root, on a clock of its own, against the regions. A plain
    weight increase of its region and rack would let rows that enter the region fall into older
    racks; with a clock of its own a row either stays where it was or goes into the new shard.

    Null keys are one key like any other. Nodes of weight 0 or less take nothing. Columns with
    the names of the result are replaced.
    """
    names = [prefix + n for n in ("region", "rack", "shard")]
    out = df.drop(*names)
    weigh = lambda rack: sum(max(w, 0.0) for _, w in rack)
    keys = [F.col(key)]
    regions = [(r, sum(map(weigh, racks))) for r, racks in enumerate(tree)]
    root = [(_draw(keys, f"region/{r}", w), r) for r, w in regions if w > 0]
    root += [(_draw(keys, f"added/{a.shard}", a.weight), -1 - i) for i, a in enumerate(added) if a.weight > 0]
    out = out.withColumn("_region", _first(_only(root))["id"])
    rack, shard = F.lit(None).cast("int"), F.lit(None).cast("int")
    for r, racks in enumerate(tree):
        drawn = [(_draw(keys, f"rack/{r}/{k}", weigh(x)), k) for k, x in enumerate(racks) if weigh(x) > 0]
        if drawn:
            rack = F.when(F.col("_region") == r, _first(drawn)["id"]).otherwise(rack)
    out = out.withColumn("_rack", rack)
    for r, racks in enumerate(tree):
        for k, shards in enumerate(racks):
            drawn = [(_draw(keys, f"shard/{s}", w), s) for s, w in shards if w > 0]
            if drawn:
                shard = F.when((F.col("_region") == r) & (F.col("_rack") == k), _first(drawn)["id"]).otherwise(shard)
    out = out.withColumn("_shard", shard)
    region, rack, shard = F.col("_region"), F.col("_rack"), F.col("_shard")
    for i, a in enumerate(added):
        new = F.col("_region") == -1 - i
        region, rack, shard = (F.when(new, F.lit(x)).otherwise(y) for x, y in ((a.region, region), (a.rack, rack), (a.shard, shard)))
    return out.withColumns(dict(zip(names, (region, rack, shard), strict=True))).drop("_region", "_rack", "_shard")


def shard_documents(docs: DataFrame, tree: Tree, grown: Added | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, region, rack, shard, slot, grown_shard) for every document.

    The law is ``key``: doc_id and the tree decide, so equal texts under different ids may part.
    size is the UTF-8 length plus 16, of a null text 16; the CRC of a null text is that of an
    empty one, 0. ``grown_shard`` is the shard with ``grown`` in the tree too, null without it.

    Slots number the rows of a shard from 0 without gaps, by doc_id and CRC; ties in any order.
    They come from range-partitioned positions, so a shard may span any number of tasks. Repeated
    rows share a shard and have slots of their own; null ids share one shard. Other columns of
    ``docs`` are left out. An empty table gives an empty result.
    """
    text = text_of()
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = assign(rows, "doc_id", tree)
    if grown is None:
        placed = placed.withColumn("grown_shard", F.lit(None).cast("int"))
    else:
        placed = assign(placed, "doc_id", tree, [grown], "grown_").drop("grown_region", "grown_rack")
    numbered = with_positions(placed, ["shard"], ["doc_id", "text_crc32"], "slot")
    return numbered.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "region", "rack", "shard",
        (F.col("slot") - 1).cast("long").alias("slot"), "grown_shard",
    )

"""Connected components of a stored edge list, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard
from .common import written


def connected(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges``; the component is its smallest node.

    Each round links every larger neighbour of a node to its smallest one, then every smaller one
    to the smallest of those. Only grouped minima and joins on a node are used, so no neighbour
    list is ever gathered; every round is a written table, and the one before it is discarded. Null ends, loops and repeated edges are
    ignored. An empty edge list gives an empty result.
    """
    now = written(
        edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        discard(now)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
        now = written(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "small-star")
        discard(large)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and two order-free checksums; equal ones mean that the round changed nothing."""
    low = F.lit(2**31)
    hashes = [F.pmod(F.xxhash64("u", "v", F.lit(seed)), low) for seed in (0, 1)]
    return tuple(edges.agg(F.count("*"), *[F.sum(h) for h in hashes]).first())

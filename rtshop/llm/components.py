"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtshop.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (``a, b``, both long); the root is the smallest node reachable.

    Large-star and small-star rounds: each node's links are moved to the smallest neighbour until only stars are left,
    which takes a number of rounds in the order of the logarithm of the longest path. Minima are aggregated before the
    shuffle, the join back may be split at a hub, and each round is written to the shared folder. Links with a null are
    left out; no links give no rows.
    """
    edges = staged(links.filter(F.col("a") != F.col("b"))
                   .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seen = _digest(edges)
    while True:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").filter(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).union(low).distinct())
        edges = staged(small, "links")
        digest = _digest(edges)
        if digest == seen:
            break
        seen = digest
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.union(stars.select(F.col("root").alias("node"), "root").distinct())


def _digest(edges: DataFrame) -> tuple:
    """Number of links and two sums of their hashes: equal digests mean that a round changed nothing."""
    hashed = F.xxhash64("u", "v").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(hashed), F.sum(F.hash("u", "v").cast("long"))).first())

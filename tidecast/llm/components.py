"""Connected components of a table of links, by large and small stars in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.session import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node of ``links (a, b)``; the root is the least node that links reach.

    Each round is written to the shared folder, and only its row count and a checksum reach the driver. Rounds grow with
    the logarithm of the longest path. Links of a node with itself, nulls and repeated links add nothing.
    """
    kept = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    at, before = cut(kept, "links"), None
    while True:
        mark = tuple(at.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if mark == before or mark[0] == 0:
            break
        before, at = mark, cut(_small_star(_large_star(at)), "links")
    roots = at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)

"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import settle


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node that it reaches.

    Each round points every node's larger neighbours at the smallest one around it, then does the same among smaller
    ones; rounds grow with the logarithm of the longest chain. Each round is written to the shared folder, so no lineage
    builds up. Minima are summed before the shuffle and joins on a hub are split, so a hub with a third of all links is
    no single task. They merge: links of a dense group pack into a few bits each, so their files say little about the rows that a
    broadcast would hold. Null ends, loops and repeated links are ignored; no links give no rows.
    """
    ends = links.filter(F.col("a") != F.col("b"))
    edges = settle(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    before, now = None, _state(edges)
    while now != before:
        both = edges.union(edges.select("v", "u")).toDF("x", "y")
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter(F.col("y") > F.col("x")).join(least.hint("merge"), "x").select(F.col("y").alias("u"), F.col("m").alias("v"))
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest.hint("merge"), "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = settle(small.union(lowest.toDF("u", "v")).distinct(), "stars")
        before, now = now, _state(edges)
    return edges.toDF("node", "root").union(edges.select("v", "v").distinct())

"""Connected components over an edge table, as alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checkwise.llm.common import stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star step: link the neighbours of each node to the smallest of them.

    Only the minimum per node is aggregated (map-side combined), then joined
    back, so a hub with any number of neighbours is never held in one place.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = both if large else both.filter("b < a")
    least = ends.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = ends.join(least, "a")
    if large:
        return joined.filter("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    linked = joined.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node each node is connected to, over links (a, b) of longs.

    Every step is written to the shared folder; the loop ends when a round
    leaves the set of links unchanged (compared by count and hash sum).
    Nodes without links do not appear.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                 .filter("a != b").distinct(), "links")
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        now = stored(_stars(stored(_stars(now, True), "large"), False), "small")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()

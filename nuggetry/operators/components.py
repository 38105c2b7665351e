"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.work import discard, settle, small


def components(links: DataFrame) -> DataFrame:
    """``links(node, root)``, edges in any direction, to ``(node, root)`` with root the smallest node of the component; roots
    are left out. Nodes are of any type that has an order.

    Alternating large-star and small-star rounds; each leaves one edge per node and round trip, smallest
    neighbours are found with map-side partial minima, and every round is written; so are the minima, which leaves the join
    with the neighbours of a large root to be broadcast or split.
    """
    spent: list[DataFrame] = []

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root"))) if large else edges
        low = both.groupBy("node").agg(F.min("root").alias("low")).select(F.col("node").alias("_n"), F.least("node", "low").alias("low"))
        spent.append(settle(low, "low"))
        near = both.join(small(spent[-1]), F.col("node") == F.col("_n"))
        if large:
            near = near.where(F.col("root") > F.col("node")).select(F.col("root").alias("node"), F.col("low").alias("root"))
        else:
            near = near.select(F.explode(F.array("node", F.when(F.col("root") != F.col("low"), F.col("root")))).alias("node"), F.col("low").alias("root"))
        return near.where("node IS NOT NULL AND node <> root").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "root")), F.sum((F.xxhash64("node", "root") % 1_000_003).cast("long"))).first())

    ordered = links.where("node <> root").select(F.greatest("node", "root").alias("node"), F.least("node", "root").alias("root")).distinct()
    edges, was = settle(ordered, "edges"), None
    while (now := state(edges)) != was:
        was, old = now, edges
        if not now[0]:
            break
        spent.append(settle(star(edges, True), "star"))
        edges = settle(star(spent[-1], False), "edges")
        for done in (old, *spent):
            discard(done)
        spent.clear()
    return edges

"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(id, component)`` for every node of an edge: the least node that can be reached.

    Large-star and small-star steps in turn: each node links its larger neighbours to its least one, then its
    smaller ones. The edges turn into stars around the least nodes in a number of rounds that grows with the logarithm
    of the graph's size. A node's least neighbour is an aggregate, so a node with very many edges is combined
    before it is shuffled; each round's edges are checkpointed to the shared folder.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v")
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()

    def state(links: DataFrame):
        return links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = state(links)  # stars around least nodes come out of a round as they went in
    for _ in range(MOST_ROUNDS):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = small.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
        now = state(links)
        if now == before:
            # each round is checkpointed, so nothing above is read again
            nodes = links.select(F.col("u").alias("id"), F.col("v").alias("component"))
            return nodes.unionByName(nodes.select(F.col("component").alias("id"), "component").distinct())
        before = now
    raise RuntimeError(f"the graph was not contracted in {MOST_ROUNDS} rounds")

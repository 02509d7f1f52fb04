"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from impactlens.storage import durable


def smallest_reachable(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the links: the smallest node it is connected with.

    Each round hangs the neighbours of every node under the smallest of them, first the larger
    neighbours, then the smaller ones; the rounds grow with the logarithm of the longest chain, and
    the edges never become more. Minima are combined before they are shuffled and each round's edges
    are checkpointed, so neither a hub nor a lost executor matters. No link is dropped and the loop
    ends only when nothing changes.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    edges = durable(links.select(low.alias("v"), high.alias("u")).filter("u > v").distinct())
    state = _state(edges)
    while state[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        hung = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))
        )
        edges = durable(hung.filter("u > v").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(
        F.min("root").alias("root")
    )


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

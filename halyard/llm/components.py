"""Connected components of an edge table, by alternating star contractions on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halyard.llm.shared import stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge to another; the component is its smallest node.

    ``edges(a, b)`` may hold repeats, both directions, loops and nulls; loops and nulls are ignored. Each
    round points every node's larger neighbours, then its smaller ones, at its smallest neighbour
    and writes the new edges to the shared folder, so lineage stays short. Rounds grow with the logarithm of
    a component's diameter. A hot node is a large key of a join, which adaptive execution splits."""
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    live = edges.select("a", "b").filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    # u is the larger end of an edge
    live = stored(live.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = live.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # every node's larger neighbours point at the smallest of its neighbourhood
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # then its smaller neighbours and itself do
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e")).select("e.u", "e.v")
        live = stored(small.filter(F.col("u") != F.col("v")).distinct(), "edges")
        seen = live.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (seen.n, seen.s) == before:
            break
        before = (seen.n, seen.s)
    else:
        raise RuntimeError("components did not settle")
    return live.select(F.col("u").alias("node"), F.col("v").alias("component")).union(live.select(F.col("v"), F.col("v")).distinct())

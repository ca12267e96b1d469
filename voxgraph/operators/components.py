"""Connected components of an undirected graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Edges (u, v) in both directions with m, the least of u and its neighbours; hubs are combined map-side."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return edges.join(least, "u")


def connected_components(pairs: DataFrame, lo: str, hi: str, max_rounds: int = 30) -> DataFrame:
    """One row (node, component) for every node that occurs in a pair; component is the least node of its part.

    Alternates large-star and small-star steps, so the number of rounds grows with the logarithm of the longest
    path, and every step is an aggregation with map-side combining and an equi-join. Pairs with a null end, and
    loops, give no edge. Raises RuntimeError if max_rounds don't suffice.
    """
    p = pairs.select(F.col(lo).alias("u"), F.col(hi).alias("v")).where("u is not null and v is not null and u <> v")
    edges = cut(p.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        star = _least_neighbour(large)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(star.select("u", F.col("m").alias("v")))
        edges = cut(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError(f"components need more than {max_rounds} rounds")
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())

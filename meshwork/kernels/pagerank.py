"""PageRank with a fixed number of iterations and dangling mass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.cut import cut, drop
from meshwork.kernels.spread import Dealt


def step(hops: Dealt, state: DataFrame, n: int, damping: float) -> DataFrame:
    """(v, deg, score) after a round: the edges are joined where they are, shares are summed before their shuffle, and the dangling mass is a one-row aggregate."""
    shares = state.select("v", "deg", (F.col("score") / F.col("deg")).alias("share"))
    sums = hops.join(shares).groupBy(F.col("dst").alias("v")).agg(F.sum("share").alias("got"))
    lost = state.where("deg = 0").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("lost"))
    return state.join(sums, "v", "left").join(F.broadcast(lost)).select("v", "deg", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("score"))


def pagerank(vertices: DataFrame, edges: DataFrame, iterations: int = 5, damping: float = 0.85) -> DataFrame:
    """(v, score): s0 = 1/n; s = (1 - d)/n + d * (sum over neighbours of s/deg + mass of vertices without edges / n)."""
    n = vertices.count()
    if not n:
        return vertices.select("v", F.lit(0.0).alias("score"))
    hops = Dealt(edges.select("src", "dst"), "src")
    state = cut(vertices.select("v").join(hops.degree, "v", "left").select("v", F.coalesce("deg", F.lit(0)).alias("deg"), F.lit(1.0 / n).alias("score")))
    for _ in range(iterations):
        past, state = state, cut(step(hops, state, n, damping))
        drop(past)
    hops.free()
    return state.select("v", "score")

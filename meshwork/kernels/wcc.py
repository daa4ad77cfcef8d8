"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.cut import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to the least of its neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every vertex links its smaller neighbours and itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _start(edges: DataFrame) -> DataFrame:
    return edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()


def contract_once(edges: DataFrame) -> DataFrame:
    """(v, component) after one large and one small star: vertices of one component may still have several labels, those of two never have one."""
    now = cut(_small_star(_large_star(_start(edges))))
    return now.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("component"))


def components(edges: DataFrame, *, most_rounds: int = 60) -> DataFrame:
    """(v, component) for each vertex of edges (src, dst) read in both directions; component is the least vertex reached.

    The two steps contract any graph to stars in a number of rounds of the order of the logarithm of its size. Each round is cut in shared
    storage; all are stars when no vertex has two edges up, or edges both up and down. Loops, doubles and nulls are dropped.
    """
    now = cut(_start(edges))
    for _ in range(most_rounds):
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():
            return now.select(F.col("u").alias("v"), F.col("v").alias("component")).unionByName(now.select("v", F.col("v").alias("component")).distinct())
        now = cut(_small_star(_large_star(now)))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def wcc(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component) of every vertex: the least id of its weakly connected component, its own if it has no edge."""
    label = components(edges.select("src", "dst"))
    return vertices.select("v").join(label, "v", "left").select("v", F.coalesce("component", "v").alias("component"))

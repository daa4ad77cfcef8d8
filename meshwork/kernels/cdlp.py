"""Community detection by synchronous label propagation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.cut import cut, drop
from meshwork.functions.ids import INT64_MAX
from meshwork.kernels.spread import Dealt


def step(hops: Dealt, state: DataFrame) -> DataFrame:
    """(v, deg, label, changed) after a round: votes are counted before their shuffle, the edges stay where they are."""
    votes = hops.join(state.select("v", "deg", "label")).groupBy(F.col("src").alias("v"), F.col("label").alias("vote")).agg(F.count("*").alias("n"))
    best = votes.groupBy("v").agg(F.max(F.struct("n", (-F.col("vote")).alias("least"))).alias("m"))
    return state.join(best, "v").select("v", "deg", (-F.col("m.least")).alias("label"), (F.col("label") != -F.col("m.least")).alias("changed"))


def cdlp(vertices: DataFrame, edges: DataFrame, max_iterations: int = 30, isolated: str = "int64max") -> DataFrame:
    """(v, label): labels begin as ids; each round takes the most frequent among the neighbours, of equal ones the smallest; ends when none changes.

    isolated: vertices without edges get 9223372036854775807, or with "self" their own id. Edges are in both directions.
    """
    hops = Dealt(edges.select("src", "dst"), "dst")
    state = cut(hops.degree.select("v", "deg", F.col("v").alias("label"), F.lit(True).alias("changed")))
    for _ in range(max_iterations):
        past, state = state, cut(step(hops, state))
        drop(past)
        if state.where("changed").isEmpty():
            break
    hops.free()
    alone = F.lit(INT64_MAX) if isolated == "int64max" else F.col("v")
    return vertices.select("v").join(state.select("v", "label"), "v", "left").select("v", F.coalesce("label", alone).alias("label"))

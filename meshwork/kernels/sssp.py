"""Single-source shortest paths by relaxing the vertices that changed."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.cut import cut, drop
from meshwork.kernels.spread import Dealt

#: Vertices that are relaxed by being sent to the edges, and of what that reaches, as lists; more are joined by a shuffle.
NARROW = 10_000
#: Distances that are held on the driver before they are merged into the table.
HELD = 100_000

STATE = "v bigint, d double"


def sssp(vertices: DataFrame, edges: DataFrame, source: int, *, delta: float | None = None, narrow: int = NARROW, held: int = HELD) -> DataFrame:
    """(v, distance): least sum of non-negative weights from ``source`` over edges (src, dst, weight); infinity if unreachable.

    The edges are dealt by src once. Each round relaxes vertices whose distance fell. Few are one small job: they are sent to the edges, the least
    offer for each vertex comes back, and just the vertices touched are compared. Many are a join in which only they move, and one aggregation
    of old distances and offers. With ``delta`` only vertices within delta of the least open distance are relaxed: fewer relaxations, more rounds.
    """
    spark = vertices.sparkSession
    if vertices.where(F.col("v") == source).isEmpty():
        return vertices.select("v", F.lit(math.inf).alias("distance"))
    hops = Dealt(edges.select("src", "dst", "weight"), "src")
    table: DataFrame | None = None  # (v, d, ...): distances in shared storage; ``patch`` holds newer ones
    patch: dict[int, float] = {source: 0.0}
    active: dict[int, float] | DataFrame = {source: 0.0}  # whose fall has not been told to their neighbours

    def merged() -> DataFrame:
        rows = spark.createDataFrame(list(patch.items()), STATE)
        return rows if table is None else table.select("v", "d").unionByName(rows).groupBy("v").agg(F.min("d").alias("d"))

    def few(df: DataFrame) -> dict[int, float] | None:
        rows = df.select("v", "d").limit(narrow + 1).collect()
        return dict(map(tuple, rows)) if len(rows) <= narrow else None

    while isinstance(active, DataFrame) or active:
        if isinstance(active, dict):
            least = min(active.values()) + (math.inf if delta is None else delta)
            now = {v: d for v, d in active.items() if d <= least}
            sent = F.broadcast(spark.createDataFrame(list(now.items()), "src bigint, d double"))
            offers = few(hops.edges.join(sent, "src").groupBy(F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("weight")).alias("d")))
            if offers is not None:
                old = {}
                if table is not None and (ask := [(v,) for v in offers if v not in patch]):
                    old = dict(map(tuple, table.join(F.broadcast(spark.createDataFrame(ask, "v bigint")), "v", "left_semi").select("v", "d").collect()))
                better = {v: d for v, d in offers.items() if d < patch.get(v, old.get(v, math.inf))}
                patch |= better
                active = {v: d for v, d in active.items() if v not in now} | better
                if len(patch) > held:
                    table, past = cut(merged()), table
                    patch = {}
                    if past is not None:
                        drop(past)
                continue
            active = spark.createDataFrame(list(active.items()), STATE)
        # a wide round: all that is open is a table
        state, past = merged(), table
        if delta is None:
            now, wait = active, None
        else:
            least = active.agg(F.min("d")).first()[0] + delta
            now, wait = active.where(F.col("d") <= least), active.where(F.col("d") > least)
        offers = hops.join(now.join(hops.degree, "v")).groupBy(F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("weight")).alias("offer"))
        rows = state.join(offers, "v", "full").select("v", F.least("d", "offer").alias("d"), (F.col("d").isNull() | (F.col("offer") < F.col("d"))).alias("fell"))
        if wait is not None:
            rows = rows.join(wait.select("v", F.lit(True).alias("wait")), "v", "left").select("v", "d", (F.coalesce("fell", F.lit(False)) | F.coalesce("wait", F.lit(False))).alias("fell"))
        table, patch = cut(rows), {}
        if past is not None:
            drop(past)
        active = table.where("fell").select("v", "d")
        if (small := few(active)) is not None:
            active = small
    hops.free()
    return vertices.select("v").join(merged() if patch else table.select("v", "d"), "v", "left").select("v", F.coalesce("d", F.lit(math.inf)).alias("distance"))

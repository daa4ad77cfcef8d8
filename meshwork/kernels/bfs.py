"""Breadth-first search by frontiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.cut import cut
from meshwork.functions.ids import UNREACHABLE
from meshwork.kernels.spread import Dealt

#: Vertices of a frontier that is sent to the edges, and of what it finds, as lists; wider levels are joined by a shuffle.
NARROW = 10_000
#: Vertices found by narrow levels that are held on the driver before they are written.
HELD = 100_000

LEVEL = "v bigint, distance bigint"


def bfs(vertices: DataFrame, edges: DataFrame, source: int, *, symmetric: bool = True, narrow: int = NARROW, held: int = HELD) -> DataFrame:
    """(v, distance): hops from ``source`` over edges (src, dst); 4294967295 if unreachable.

    The edges are dealt by src once. A narrow level is one small job: its frontier is sent to the edges, and at most ``narrow`` vertices come
    back. A wide level is a join in which only the frontier moves. In a symmetric graph a neighbour of level k is in level k - 1, k or k + 1, so
    two levels tell what is new; else all levels do, and all are joined.
    """
    spark = vertices.sparkSession
    if vertices.where(F.col("v") == source).isEmpty():
        return vertices.select("v", F.lit(UNREACHABLE).alias("distance"))
    hops = Dealt(edges.select("src", "dst"), "src")
    written: list[tuple[int, DataFrame]] = []  # levels in shared storage, with the last depth of each part
    local: list[tuple[int, int]] = [(source, 0)]  # and those not yet written
    frontier: set[int] | DataFrame = {source}
    before: set[int] | None = set() if symmetric else {source}  # what a narrow level may meet again; None: that is not held
    depth = 0

    def flush() -> None:
        if local:
            written.append((local[-1][1], cut(spark.createDataFrame(local, LEVEL))))
            local.clear()

    while not isinstance(frontier, set) or frontier:
        depth += 1
        if isinstance(frontier, set) and before is not None:
            sent = F.broadcast(spark.createDataFrame([(v,) for v in frontier], "src bigint"))
            rows = hops.edges.join(sent, "src").select("dst").distinct().limit(narrow + 1).collect()
            if len(rows) <= narrow:
                found = {r[0] for r in rows} - frontier - before
                local += [(v, depth) for v in sorted(found)]
                before = frontier if symmetric else before | found
                if not symmetric and len(before) > held:
                    before = None
                if len(local) > held:
                    flush()
                frontier = found
                continue
        flush()
        now = frontier if isinstance(frontier, DataFrame) else spark.createDataFrame([(v,) for v in frontier], "v bigint")
        seen = reduce(DataFrame.unionByName, (df for end, df in written if not symmetric or end >= depth - 2)).select("v")
        found = hops.join(now.join(hops.degree, "v")).select(F.col("dst").alias("v")).distinct().join(seen, "v", "left_anti")
        level = cut(found.withColumn("distance", F.lit(depth).cast("bigint")))
        written.append((depth, level))
        few = [{r[0] for r in df.limit(narrow + 1).collect()} for df in ((now, level) if symmetric else (level,))]
        if not few[-1]:
            break
        before = few[0] if symmetric and max(map(len, few)) <= narrow else None
        frontier = few[-1] if before is not None else level.select("v")
    flush()
    hops.free()
    reached = reduce(DataFrame.unionByName, (df for _, df in written))
    return vertices.select("v").join(reached, "v", "left").select("v", F.coalesce("distance", F.lit(UNREACHABLE)).alias("distance"))

"""Self-tests of a stored graph and of kernels: gold values, inserted edges, deleted edges, storage after compaction."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.cut import cut
from meshwork.graph import Graph
from meshwork.operators import ingest, report
from meshwork.txn import Store


def against_gold(result: DataFrame, path: str, tolerance: float = 1e-4) -> DataFrame | None:
    """Compare (v, value) with the Parquet gold values at ``path``: (v, value, expected) where they differ. If there are none yet, write them; None then."""
    spark = result.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        result.select("v", "value").orderBy("v").write.parquet(path)
        return None
    return report.compare(result, spark.read.parquet(path), tolerance)


def inserted(graph: Graph, edges: DataFrame, *, undirected: bool = True, source: int | None = None) -> dict[str, int]:
    """How a graph differs from the edges (src, dst[, weight]) that all were inserted into it.

    missing: edges that it lacks; extra: edges that it has besides; weights: edges of another weight; degrees: vertices of another degree; distances:
    vertices at another distance from ``source`` than in a graph of the edges alone. All are 0 where the inserts worked.
    """
    wanted = cut(ingest.symmetric(edges) if undirected else edges).distinct()
    ends = ["src", "dst"]
    seen = cut(graph.edges)
    out = {"missing": wanted.join(seen, ends, "left_anti").count(), "extra": seen.join(wanted, ends, "left_anti").count(), "weights": 0, "distances": 0}
    if "weight" in edges.columns and "weight" in seen.columns:
        both = wanted.select(*ends, F.col("weight").alias("w")).join(seen, ends)
        out["weights"] = both.where(~F.col("w").eqNullSafe(F.col("weight"))).count()
    vertices = cut(wanted.select(F.col("src").alias("v")).unionByName(wanted.select(F.col("dst").alias("v"))).distinct())
    at = lambda g, name: ingest.degrees(vertices, g).withColumnRenamed("degree", name)
    out["degrees"] = at(seen, "a").join(at(wanted, "b"), "v").where("a <> b").count()
    if source is not None:
        far = lambda g, name: Graph(vertices, g).bfs(source, symmetric=undirected).withColumnRenamed("distance", name)
        out["distances"] = far(seen, "a").join(far(wanted, "b"), "v").where("a <> b").count()
    return out


def deleted(store: Store, edges: DataFrame) -> int:
    """How many of ``edges`` (src, dst) the newest state still holds."""
    return store.snapshot().edges.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_semi").count()


def compaction(spark: SparkSession, store: Store) -> DataFrame:
    """One row: log rows and bytes before and after a compaction and a vacuum, and the microseconds that they took."""
    rows, size = store.log().count(), store.storage()
    began = time.perf_counter()
    store.compact()
    store.vacuum()
    took = int((time.perf_counter() - began) * 1e6)
    after = store.storage()
    fields = "rows_before long, rows_after long, bytes_before long, bytes_after long, runtime long"
    return spark.createDataFrame([(rows, store.log().count(), size["edges"] + size["superseded"], after["edges"] + after["superseded"], took)], fields)


def degree_reports(graphs: dict[str, DataFrame]) -> DataFrame:
    """(graph, max_degree, zero, under_10, under_20, under_100) of named degree tables (v, degree)."""
    out = None
    for name, degree in graphs.items():
        one = ingest.degree_characteristics(degree).select(F.lit(name).alias("graph"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no graph is named")
    return out

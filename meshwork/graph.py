"""A snapshot of a property graph, its reads and its kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.errors import NoProperties
from meshwork.kernels.bfs import bfs
from meshwork.kernels.cdlp import cdlp
from meshwork.kernels.lcc import lcc, triangle_count, triangles
from meshwork.kernels.pagerank import pagerank
from meshwork.kernels.sssp import sssp
from meshwork.kernels.wcc import wcc
from meshwork.operators import ingest


class Graph:
    """vertices (v) and edges (src, dst[, weight]), the latter in both directions for undirected graphs.

    Reads of given vertices, edges or pairs are joins, so Spark broadcasts small requests itself and shuffles large ones.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame):
        self.vertices, self.edges = vertices.select("v"), edges

    @staticmethod
    def of_edges(edges: DataFrame, undirected: bool = True) -> Graph:
        both = ingest.symmetric(edges) if undirected else edges
        return Graph(edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v"))).distinct(), both)

    def vertex_count(self) -> int:
        return self.vertices.count()

    def max_vertex(self) -> DataFrame:
        """(top): one more than the greatest vertex id, 0 of an empty graph."""
        return self.vertices.agg(F.coalesce(F.max("v") + 1, F.lit(0)).alias("top"))

    def edge_count(self) -> int:
        """Directed edges: an undirected one counts twice."""
        return self.edges.count()

    def property_size(self) -> int:
        """Bytes of an edge's property."""
        return 8 if "weight" in self.edges.columns else 0

    def has_vertices(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (v, ...) with ``present``."""
        return wanted.join(self.vertices.select("v", F.lit(True).alias("present")), "v", "left").fillna(False, ["present"])

    def has_edges(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (src, dst, ...) with ``present``; false too where an end is no vertex."""
        return wanted.join(self.edges.select("src", "dst", F.lit(True).alias("present")).distinct(), ["src", "dst"], "left").fillna(False, ["present"])

    def weights(self, wanted: DataFrame) -> DataFrame:
        """``wanted`` (src, dst) that exist, with their weights."""
        if "weight" not in self.edges.columns:
            raise NoProperties("the graph has no weights")
        return wanted.join(self.edges.select("src", "dst", "weight"), ["src", "dst"])

    def degrees(self) -> DataFrame:
        return ingest.degrees(self.vertices, self.edges)

    def neighbours(self, wanted: DataFrame) -> DataFrame:
        """The edges from the vertices of ``wanted`` (v), with weights if there are any."""
        return self.edges.join(wanted.select(F.col("v").alias("src")).distinct(), "src", "left_semi")

    def intersect(self, pairs: DataFrame) -> DataFrame:
        """(a, b, v): the common neighbours of each pair (a, b)."""
        near = self.edges.select("src", "dst").distinct()
        left = pairs.select("a", "b").distinct().join(near, F.col("a") == F.col("src")).select("a", "b", F.col("dst").alias("v"))
        return left.join(near.select(F.col("src").alias("b"), F.col("dst").alias("v")), ["b", "v"], "left_semi").select("a", "b", "v")

    def extremes(self) -> DataFrame:
        """(src, degree, least, greatest) of every vertex with edges."""
        return self.edges.groupBy("src").agg(F.count("*").alias("degree"), F.min("dst").alias("least"), F.max("dst").alias("greatest"))

    def adjacency(self) -> DataFrame:
        """(src, neighbours): sorted arrays."""
        return self.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("neighbours"))

    def bfs(self, source: int, symmetric: bool = True) -> DataFrame:
        return bfs(self.vertices, self.edges, source, symmetric=symmetric)

    def pagerank(self, iterations: int = 5, damping: float = 0.85) -> DataFrame:
        return pagerank(self.vertices, self.edges, iterations, damping)

    def sssp(self, source: int, delta: float | None = None) -> DataFrame:
        return sssp(self.vertices, self.edges, source, delta=delta)

    def wcc(self) -> DataFrame:
        return wcc(self.vertices, self.edges)

    def lcc(self) -> DataFrame:
        return lcc(self.vertices, self.edges)

    def triangles(self) -> DataFrame:
        return triangles(self.edges)

    def triangle_count(self) -> int:
        return triangle_count(self.edges)

    def cdlp(self, max_iterations: int = 30, isolated: str = "int64max") -> DataFrame:
        return cdlp(self.vertices, self.edges, max_iterations, isolated)

    def source_candidate(self, share: float = 0.75) -> DataFrame:
        """(source): the least vertex of a component with over ``share`` of all vertices; no row if there is none."""
        label = self.wcc()
        sizes = label.groupBy("component").agg(F.count("*").alias("n"), F.min("v").alias("source"))
        return sizes.join(F.broadcast(self.vertices.agg(F.count("*").alias("all"))), F.col("n") > share * F.col("all")).select("source")

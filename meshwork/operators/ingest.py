"""Cleaning, numbering, splitting and laying out edge lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.functions.ids import number_rows


def canonical(edges: DataFrame) -> DataFrame:
    """Undirected edges with src < dst (loops stay)."""
    return edges.withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def first_of_each(edges: DataFrame, pos: str = "pos") -> DataFrame:
    """One row for each (src, dst), the one with the least ``pos``, payload and all; combined before the shuffle."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.groupBy("src", "dst").agg(F.min(F.struct(pos, *[c for c in rest if c != pos])).alias("m")).select("src", "dst", *(F.col(f"m.{c}").alias(c) for c in rest))


def clean(edges: DataFrame, pos: str = "pos", undirected: bool = True) -> DataFrame:
    """Canonical if undirected, without loops, first occurrences only."""
    return first_of_each(without_loops(canonical(edges) if undirected else edges), pos)


def symmetric(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, with its other columns."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))


def dictionary(edges: DataFrame, pos: str = "pos") -> DataFrame:
    """(name, id): names of src and dst numbered from 0 by their first appearance, src before dst in a row."""
    seen = edges.select(pos, F.posexplode(F.array("src", "dst")).alias("side", "name"))
    return number_rows(seen.groupBy("name").agg(F.min(F.struct(pos, "side")).alias("first")), "first", "name", name="id").select("name", "id")


def densify(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges with names replaced by their ids."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    a, b = names.select(F.col("name").alias("src"), F.col("id").alias("s")), names.select(F.col("name").alias("dst"), F.col("id").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), *rest)


def with_weights(edges: DataFrame, weight: Column | None = None) -> DataFrame:
    """Deterministic weights in [0.01, 1.0), by a hash of the canonical edge if no expression is given."""
    if weight is None:
        weight = 0.01 + 0.99 * F.pmod(F.xxhash64(F.least("src", "dst"), F.greatest("src", "dst")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return edges.withColumn("weight", weight)


def shuffled(edges: DataFrame, seed: int = 42) -> DataFrame:
    """A random but repeatable order of edges, as the column ``pos``."""
    return number_rows(edges.drop("pos"), F.xxhash64(F.lit(seed), "src", "dst"), "src", "dst", name="pos")


def split(edges: DataFrame, insert_share: float, delete_share: float, *order: Column | str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, inserts, deletes) of edges in the given total order: inserts are the last share, deletes the first, base all but the inserts."""
    rows = number_rows(edges, *order, name="idx")
    n = rows.count()
    take = lambda p: n if p > 0.9999999999 else int(p * n)
    first = n - take(insert_share)
    return rows.where(F.col("idx") < first), rows.where(F.col("idx") >= first), rows.where(F.col("idx") < take(delete_share))


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, degree) of every vertex by src."""
    counts = edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))
    return vertices.join(counts, "v", "left").select("v", F.coalesce("degree", F.lit(0)).alias("degree"))


def csr_offsets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, begin, end): where each vertex' neighbours stand among edges sorted by (src, dst), empty vertices too.

    An exclusive prefix sum in two levels: within ranges of vertices, then over the ranges' totals.
    """
    from meshwork.cut import cut

    rows = cut(degrees(vertices, edges).repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy("part").agg(F.sum("degree").alias("n"))
    before = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("degree").over(Window.partitionBy("part").orderBy("v"))
    return rows.withColumn("inside", inside).join(F.broadcast(before), "part").select("v", (F.col("before") + F.col("inside") - F.col("degree")).alias("begin"), (F.col("before") + F.col("inside")).alias("end"))


def degree_characteristics(degree: DataFrame) -> DataFrame:
    """One row: the greatest degree and the shares of vertices of degree 0, under 10, 20 and 100."""
    under = lambda k: F.avg((F.col("degree") < k).cast("double"))
    return degree.agg(F.max("degree").alias("max_degree"), under(1).alias("zero"), under(10).alias("under_10"), under(20).alias("under_20"), under(100).alias("under_100"))


def degree_histogram(degree: DataFrame, width: int = 30) -> DataFrame:
    """(bin, vertices, cdf): counts by bins of ``width`` degrees and their cumulative share; the window holds a row for each bin."""
    bins = degree.groupBy(F.floor(F.col("degree") / width).cast("bigint").alias("bin")).agg(F.count("*").alias("vertices"))
    total = F.sum("vertices").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return bins.select("bin", "vertices", (F.sum("vertices").over(Window.orderBy("bin")) / total).alias("cdf"))

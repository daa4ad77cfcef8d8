"""The versioned edge log.

A row is (version, seq, op, src, dst, weight). Ops are INSERT, UPSERT and DELETE; of one version those of the lower seq come first. Only
effective rows are stored (``normalise``), so the state at a version is the newest row up to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.errors import SnapshotGone

SCHEMA = "version bigint, seq int, op string, src bigint, dst bigint, weight double"
#: The order of operations in one transaction.
SEQ = {"DELETE": 0, "INSERT": 1, "UPSERT": 2}


def seq_of(op: Column) -> Column:
    return F.when(op == "DELETE", 0).when(op == "INSERT", 1).otherwise(2)


def _order() -> list[Column]:
    return [F.col("version"), seq_of(F.col("op"))]


def with_prior(raw: DataFrame) -> DataFrame:
    """``raw`` with ``present``: whether the edge exists before the row. An op alone tells the state after it, so the op before does."""
    prior = F.lag("op").over(Window.partitionBy("src", "dst").orderBy(*_order()))
    return raw.withColumn("present", F.coalesce(prior != "DELETE", F.lit(False)))


def normalise(raw: DataFrame) -> DataFrame:
    """Effective rows in relaxed semantics: inserts of absent edges, deletes of present ones, every upsert."""
    return with_prior(raw).where((F.col("op") == "UPSERT") | ((F.col("op") == "INSERT") & ~F.col("present")) | ((F.col("op") == "DELETE") & F.col("present"))).drop("present")


def violations(raw: DataFrame) -> DataFrame:
    """Rows that strict semantics refuse, with why: EdgeExists or EdgeDoesNotExist."""
    rows = with_prior(raw)
    why = F.when((F.col("op") == "INSERT") & F.col("present"), "EdgeExists").when((F.col("op") == "DELETE") & ~F.col("present"), "EdgeDoesNotExist")
    return rows.withColumn("why", why).where("why IS NOT NULL").drop("present")


def newest(log: DataFrame, version: int) -> DataFrame:
    """(src, dst, version, op, weight) of each edge's newest row up to a version; combined before the shuffle."""
    last = F.max(F.struct("version", seq_of(F.col("op")).alias("seq"), "op", "weight")).alias("m")
    return log.where(F.col("version") <= version).groupBy("src", "dst").agg(last).select("src", "dst", "m.version", "m.op", "m.weight")


def snapshot(log: DataFrame, version: int) -> DataFrame:
    """(src, dst, weight) of the edges visible at a version of a normalised log."""
    return newest(log, version).where("op <> 'DELETE'").select("src", "dst", "weight")


def weight_history(log: DataFrame) -> DataFrame:
    """(src, dst, version, until, weight): the versions [version, until) in which an edge has a weight; until is null while it lasts."""
    until = F.lead("version").over(Window.partitionBy("src", "dst").orderBy(*_order()))
    return log.withColumn("until", until).where("op <> 'DELETE'").select("src", "dst", "version", "until", "weight")


def degree_history(log: DataFrame) -> DataFrame:
    """(v, version, degree): the out-degree after each version that changes it."""
    change = F.when(F.col("op") == "DELETE", -1).when(F.col("present"), 0).otherwise(1)
    moves = with_prior(log).groupBy(F.col("src").alias("v"), "version").agg(F.sum(change).alias("change")).where("change <> 0")
    return moves.select("v", "version", F.sum("change").over(Window.partitionBy("v").orderBy("version")).alias("degree"))


def degrees_at(log: DataFrame, version: int) -> DataFrame:
    return snapshot(log, version).groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def slotted(log: DataFrame, marks: list[int]) -> DataFrame:
    """``log`` with __slot: the index of the first of the ascending ``marks`` that is not before the row's version.

    The slots of the log's distinct versions are a small table, so thousands of marks make no larger plan.
    """
    ends = F.lit(marks).cast("array<bigint>")
    slots = log.select("version").distinct().select("version", F.size(F.filter(ends, lambda m: m < F.col("version"))).alias("__slot"))
    return log.join(slots, "version").select(*log.columns, "__slot")


def compact(log: DataFrame, active: list[int]) -> DataFrame:
    """A normalised log without the rows that no active version and none after the youngest reads.

    Of each edge stay, for each active version, its newest row up to it, and all rows after the youngest; tombstones up to the oldest
    active version go where nothing older is left to hide.
    """
    if not active:
        return log
    marks = sorted(set(active))
    rows = slotted(log, marks)
    latest = F.row_number().over(Window.partitionBy("src", "dst", "__slot").orderBy(F.desc("version"), seq_of(F.col("op")).desc()))
    kept = rows.withColumn("__k", latest).where((F.col("__slot") == len(marks)) | (F.col("__k") == 1))
    first = F.row_number().over(Window.partitionBy("src", "dst").orderBy(*_order()))
    return kept.withColumn("__f", first).where(~((F.col("__f") == 1) & (F.col("op") == "DELETE"))).drop("__slot", "__k", "__f")


def readable(version: int, active: list[int]) -> None:
    """Refuse a version that compaction with ``active`` has merged away."""
    if active and version < max(active) and version not in active:
        raise SnapshotGone(f"version {version} was neither active nor after {max(active)} when the log was compacted")


def versions_of(log: DataFrame, src: int, dst: int) -> DataFrame:
    return log.where((F.col("src") == src) & (F.col("dst") == dst)).select("version")

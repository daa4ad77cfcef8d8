"""Edges that are dealt once and stay where they are over the rounds of a kernel."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.cut import cut

#: Edges of one vertex that a task should hold; vertices with more are dealt over several.
HUB = 100_000
ADAPTIVE = "spark.sql.adaptive.enabled"


class Dealt:
    """Edges partitioned by (key, salt) and kept on the executors; a lost part is read again from the checkpoint.

    A vertex with more than ``hub`` edges has several salts, and ``at`` copies its row for each, so that a join on the key neither moves the edges
    nor gathers a hub's edges in one task.
    """

    def __init__(self, edges: DataFrame, key: str, hub: int = HUB):
        self.key, self.hub = key, hub
        base = cut(edges)
        self.degree = cut(base.groupBy(F.col(key).alias("v")).agg(F.count("*").alias("deg")))
        other = "dst" if key == "src" else "src"
        hubs = self.degree.where(F.col("deg") > hub).select(F.col("v").alias(key), self._salts(F.col("deg")).alias("salts"))
        if hubs.isEmpty():
            rows = base.withColumn("salt", F.pmod(F.col(other), F.lit(1)).cast("int"))  # 0, but no constant: that would be left out of the partitioning
        else:
            rows = base.join(hubs, key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(other), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
        spark = edges.sparkSession
        before = spark.conf.get(ADAPTIVE)
        spark.conf.set(ADAPTIVE, "false")  # read when the plan to keep is made, here: adaptive execution would forget how the edges lie
        try:
            self.edges = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key, "salt").persist(StorageLevel.MEMORY_AND_DISK)
        finally:
            spark.conf.set(ADAPTIVE, before)

    def _salts(self, degree: Column) -> Column:
        return F.floor((degree - 1) / self.hub) + 1

    def at(self, state: DataFrame, deg: str = "deg") -> DataFrame:
        """``state`` (v, deg, ...) as rows that ``edges`` join on (key, salt)."""
        salts = F.sequence(F.lit(0), (self._salts(F.col(deg)) - 1).cast("int"))
        return state.where(F.col(deg) > 0).withColumn("salt", F.explode(salts)).withColumnRenamed("v", self.key)

    def join(self, state: DataFrame, deg: str = "deg") -> DataFrame:
        return self.edges.join(self.at(state, deg).hint("shuffle_hash"), [self.key, "salt"])

    def free(self) -> None:
        self.edges.unpersist()

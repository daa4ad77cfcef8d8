"""Fixed ids and global row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.cut import cut

#: Hops to an unreachable vertex, and the label of an isolated one.
UNREACHABLE = 4294967295
INT64_MAX = 9223372036854775807


def number_rows(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """``df`` with consecutive numbers from 0 in the given total order.

    A range sort, cut in shared storage; then each partition's first number, from the counts of those before it (a row for each
    partition). No task holds more than its range.
    """
    rows = cut(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    counts = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    # low bits count a partition's rows from 0
    return rows.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__part", "__before", "__at")


def next_power_of_two(x: Column) -> Column:
    """The least power of two that is x or more."""
    return F.when(x <= 1, F.lit(1).cast("bigint")).otherwise(F.pow(F.lit(2.0), F.ceil(F.log2(x.cast("double")))).cast("bigint"))

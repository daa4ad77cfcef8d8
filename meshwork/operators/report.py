"""Reports of benchmark runs: (execution_id, timestamp, repetition, dataset, experiment, data_structure, runtime, storage)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "execution_id bigint, timestamp bigint, repetition int, dataset string, experiment string, data_structure string, runtime bigint, storage bigint"


def read(spark: SparkSession, path: str) -> DataFrame:
    """A ``;`` CSV with a comment line, a header and a trailing separator."""
    rows = spark.read.schema(SCHEMA + ", __end string").csv(path, sep=";", header=True, comment="#", enforceSchema=True)
    return rows.drop("__end")


def write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep=";", header=True)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def next_execution_id(rows: DataFrame) -> DataFrame:
    return rows.agg((F.coalesce(F.max("execution_id"), F.lit(0)) + 1).alias("execution_id"))


def warm(rows: DataFrame) -> DataFrame:
    return rows.where("repetition > 2")


def cold(rows: DataFrame) -> DataFrame:
    return rows.where("repetition = 0")


def latest(rows: DataFrame, since: int | None = None) -> DataFrame:
    """Rows of the newest execution, or of all from ``since``."""
    if since is not None:
        return rows.where(F.col("execution_id") >= since)
    return rows.join(F.broadcast(rows.agg(F.max("execution_id").alias("execution_id"))), "execution_id", "left_semi")


def dataset_name(path: Column) -> Column:
    """The second-last part of a path."""
    return F.element_at(F.split(path, "/"), -2)


def mean(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.avg("runtime").alias("mean_runtime"))


def medians(rows: DataFrame, *keys: str) -> DataFrame:
    """Exact median of the non-null runtimes of each group."""
    return rows.where("runtime IS NOT NULL").groupBy(*keys).agg(F.expr("percentile(runtime, 0.5)").alias("median_runtime"))


def quartiles(rows: DataFrame, *keys: str) -> DataFrame:
    p = F.expr("percentile(runtime, array(0.25, 0.5, 0.75))")
    return rows.groupBy(*keys).agg(F.min("runtime").alias("least"), p[0].alias("q1"), p[1].alias("q2"), p[2].alias("q3"), F.max("runtime").alias("greatest"))


def pivot(rows: DataFrame, keys: list[str], column: str, values: list[str], how: str = "avg") -> DataFrame:
    """A column for each of the given values."""
    out = rows.groupBy(*keys).pivot(column, values)
    return out.agg(F.avg("runtime") if how == "avg" else F.first("runtime", ignorenulls=True))


def cumcount(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """Rows with their number from 0 within their group."""
    return rows.withColumn("n", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))


def percent_over_best(rows: DataFrame, key: str, value: str) -> DataFrame:
    """How many per cent each row's value is over the least of its group."""
    best = rows.groupBy(key).agg(F.min(value).alias("best"))
    return rows.join(best, key).withColumn("percent", 100.0 * (F.col(value) - F.col("best")) / F.col("best"))


def ratio(rows: DataFrame, key: str, column: str, over: str, under: str) -> DataFrame:
    wide = pivot(rows, [key], column, [over, under])
    return wide.select(key, (F.col(f"`{over}`") / F.when(F.col(f"`{under}`") != 0, F.col(f"`{under}`"))).alias("ratio"))


def compare(result: DataFrame, gold: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(v, value, expected) where a result differs from the gold values by over ``tolerance``, or one lacks a vertex; NaN and infinities equal themselves."""
    a, b = F.col("value").cast("double"), F.col("expected").cast("double")
    both = result.select("v", "value").join(gold.select("v", F.col("value").alias("expected")), "v", "full")
    same = F.coalesce((a == b) | (F.abs(a - b) <= tolerance), F.lit(False))
    return both.where(~same)


def timed(run: Callable[[], DataFrame], repetitions: int = 3) -> list[float]:
    """Microseconds of each run of a query, its result written nowhere."""
    out = []
    for _ in range(repetitions):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        out.append((time.perf_counter() - began) * 1e6)
    return out

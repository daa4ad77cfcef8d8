"""Graphs and logs derived from the driver's tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork import log as edge_log
from meshwork.cut import cut
from meshwork.graph import Graph
from meshwork.operators.ingest import symmetric


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def copart(spark: SparkSession, sf_dir: str, least_quantity: float | None = None) -> DataFrame:
    """(src, dst, weight), src < dst: parts that share an order; the least sum of their quantities / 100 as weight."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    if least_quantity is not None:
        items = items.where(F.col("l_quantity") >= least_quantity)
    other = items.toDF("l_orderkey", "part", "quantity")
    pairs = items.join(other, "l_orderkey").where("l_partkey < part")
    return pairs.groupBy(F.col("l_partkey").alias("src"), F.col("part").alias("dst")).agg((F.min(F.col("l_quantity") + F.col("quantity")) / 100.0).alias("weight"))


def copairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst), src < dst: the edges of ``copart`` without weights, once for each order. Both sides of the join read one shuffle."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    pairs = items.alias("a").join(items.alias("b"), F.col("a.l_orderkey") == F.col("b.l_orderkey")).where("a.l_partkey < b.l_partkey")
    return pairs.select(F.col("a.l_partkey").alias("src"), F.col("b.l_partkey").alias("dst"))


def g1(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.of_edges(cut(copart(spark, sf_dir)))


def g2(spark: SparkSession, sf_dir: str, all_parts: bool = False) -> Graph:
    graph = Graph.of_edges(cut(copart(spark, sf_dir, 45)))
    return Graph(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("v")), graph.edges) if all_parts else graph


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(version, op, src, dst, weight) of the events."""
    op = F.when(F.col("event_type") == "error", "DELETE").when(F.col("event_type") == "purchase", "UPSERT").otherwise("INSERT")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("version"), op.alias("op"), F.col("user_id").alias("src"), (1000000 + k).alias("dst"), F.col("value").alias("weight"))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edge_log.normalise(raw_log(spark, sf_dir))


def text_lines(spark: SparkSession, sf_dir: str, temporal: bool = False) -> DataFrame:
    """(pos, value): the events as lines of a text edge list; each tenth is a comment."""
    last = F.unix_timestamp("ts").cast("string") if temporal else F.col("value").cast("string")
    line = F.concat_ws(" ", F.col("user_id").cast("string"), F.get_json_object("props", "$.k"), last)
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("pos"), F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("# "), line)).otherwise(line).alias("value"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A benchmark report made of the events: a user is an execution, its events in order the repetitions."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("execution_id"), F.unix_timestamp("ts").alias("timestamp"), (at - 1).cast("int").alias("repetition"), F.concat_ws("/", F.lit("data"), F.concat(F.lit("g"), (F.col("event_id") % 5).cast("string")), F.lit("base.csr")).alias("dataset"),
        F.col("event_type").alias("experiment"), F.concat(F.lit("s"), (F.col("event_id") % 2).cast("string")).alias("data_structure"), F.round(F.col("value") * 1000).cast("bigint").alias("runtime"), F.lit(None).cast("bigint").alias("storage"),
    )


_U = """SELECT least(a.l_partkey, b.l_partkey) src, greatest(a.l_partkey, b.l_partkey) dst, min(a.l_quantity + b.l_quantity) / 100.0 w
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey WHERE a.l_partkey <> b.l_partkey{where} GROUP BY 1, 2"""
_E = "u AS ({u}), e AS (SELECT src, dst, w FROM u UNION ALL SELECT dst, src, w FROM u)"
G1 = _E.format(u=_U.format(where=""))
G2 = _E.format(u=_U.format(where=" AND a.l_quantity >= 45 AND b.l_quantity >= 45"))
VX = "vx AS (SELECT DISTINCT src v FROM e)"
PARTS = "vx AS (SELECT p_partkey v FROM part)"
RAW = """raw AS (SELECT event_id AS version, CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'purchase' THEN 'UPSERT' ELSE 'INSERT' END AS op,
  user_id AS src, 1000000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst, value AS weight FROM events),
prior AS (SELECT *, lag(op) OVER (PARTITION BY src, dst ORDER BY version) AS prev FROM raw)"""
LOG = RAW + """, l AS (SELECT * FROM prior WHERE op = 'UPSERT' OR (op = 'INSERT' AND (prev IS NULL OR prev = 'DELETE')) OR (op = 'DELETE' AND prev IN ('INSERT', 'UPSERT')))"""
RUNS = """runs AS (SELECT user_id AS execution_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS repetition,
  'g' || CAST(event_id % 5 AS VARCHAR) AS ds, 'data/g' || CAST(event_id % 5 AS VARCHAR) || '/base.csr' AS dataset, event_type AS experiment, 's' || CAST(event_id % 2 AS VARCHAR) AS data_structure,
  CAST(round(value * 1000) AS BIGINT) AS runtime FROM events)"""

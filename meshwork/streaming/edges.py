"""Ordered edge operations as a stream into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meshwork.txn import Store


def apply_batch(store: Store, rows: DataFrame, *, undirected: bool = False, stream: str | None = None, batch: int = 0) -> int:
    """One relaxed commit of a micro-batch (op, src, dst[, weight][, pos]) in which the last op of an edge counts.

    Rows are in the order of pos; without it in that of the batch's partitions, and of the rows in these. undirected: each op counts in both
    directions. A batch of a named stream is committed once, however often it comes. Returns the version.
    """
    weight = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(None).cast("double")
    order = F.col("pos").cast("bigint") if "pos" in rows.columns else F.monotonically_increasing_id()
    ops = rows.select(order.alias("pos"), "op", F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), weight.alias("weight"))
    if undirected:
        ops = ops.unionByName(ops.where("src <> dst").select("pos", "op", F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    last = ops.groupBy("src", "dst").agg(F.max(F.struct("pos", "op", "weight")).alias("m")).select("src", "dst", "m.op", "m.weight")
    txn = store.begin(write_only=True, relaxed_vertices=True, relaxed_edges=True)
    if stream is not None:
        txn.of_stream(stream, batch)
    txn.insert_vertices(last.select(F.explode(F.array("src", "dst")).alias("v")).distinct())
    for op, put in (("DELETE", txn.delete_edges), ("INSERT", txn.insert_edges), ("UPSERT", txn.upsert_edges)):
        put(last.where(F.col("op") == op))
    return txn.execute()


def ingest(stream: DataFrame, store: Store, checkpoint: str, *, undirected: bool = False, **trigger) -> StreamingQuery:
    """Commit each micro-batch of a streaming DataFrame (op, src, dst[, weight][, pos]) as a version; reads use a fixed version meanwhile.

    A batch that Spark replays after a failure is not committed again: the manifest holds the last batch of each stream (by its checkpoint).
    """
    apply = lambda rows, batch: apply_batch(store, rows, undirected=undirected, stream=checkpoint, batch=batch) and None
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def insert_all(store: Store, edges: DataFrame, *, undirected: bool = False, batches: int = 1) -> list[int]:
    """Insert a whole stream of edges (src, dst[, weight], pos) in ``batches`` commits by ranges of pos; returns their versions."""
    last = edges.agg(F.max("pos")).first()[0]
    if last is None:
        return []
    size = -(-(last + 1) // batches)
    parts = [edges.where((F.col("pos") >= k * size) & (F.col("pos") < (k + 1) * size)) for k in range(batches)]
    return [apply_batch(store, p.withColumn("op", F.lit("INSERT")), undirected=undirected) for p in parts]


def delete_all(store: Store, edges: DataFrame, *, undirected: bool = False) -> int:
    """Delete a whole stream of edges (src, dst) in one commit."""
    return apply_batch(store, edges.select("src", "dst").withColumn("op", F.lit("DELETE")), undirected=undirected)

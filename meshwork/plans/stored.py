"""Queries that go through files and the store, each in a new folder of the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from meshwork.cut import cut, ensure_checkpoint_dir
from meshwork.functions import ids
from meshwork.operators import ingest, verify
from meshwork.plans import fixtures as fx
from meshwork.plans.catalog import G1, G2, VX, query
from meshwork.sources import binary
from meshwork.streaming import edges as streaming
from meshwork.txn import Store


def scratch(spark) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/meshwork-{uuid.uuid4().hex}"


def _history(spark, sf) -> Store:
    """The events in four commits: that of version k has the events whose id leaves k - 1 modulo 4, the last op of an edge counts."""
    store = Store(spark, scratch(spark))
    rows = cut(fx.raw_log(spark, sf).withColumnRenamed("version", "pos"))
    for k in range(4):
        streaming.apply_batch(store, rows.where(F.col("pos") % 4 == k), stream="events", batch=k)
        streaming.apply_batch(store, rows.where(F.col("pos") % 4 == k), stream="events", batch=k)  # a replay does nothing
    return store


_COMMITS = f"""{fx.RAW}, b AS (SELECT event_id % 4 + 1 AS version, user_id AS src, 1000000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst,
  max_by(CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'purchase' THEN 'UPSERT' ELSE 'INSERT' END, event_id) AS op, max_by(value, event_id) AS weight FROM events GROUP BY 1, 2, 3),
p AS (SELECT *, lag(op) OVER (PARTITION BY src, dst ORDER BY version) AS before FROM b),
h AS (SELECT * FROM p WHERE op = 'UPSERT' OR (op = 'INSERT' AND (before IS NULL OR before = 'DELETE')) OR (op = 'DELETE' AND before IN ('INSERT', 'UPSERT'))),
n AS (SELECT t.v AS version, src, dst, max_by(op, h.version) AS op, max_by(weight, h.version) AS weight FROM h JOIN (SELECT unnest([1, 2, 3, 4]) AS v) t ON h.version <= t.v GROUP BY 1, 2, 3)"""


def _snapshots(store: Store, versions: list[int]):
    out = None
    for v in versions:
        one = store.snapshot(v).edges.select(F.lit(v).alias("version"), "src", "dst", "weight")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {_COMMITS} SELECT version, src, dst, weight FROM n WHERE op <> 'DELETE'")
def store_history(spark, sf):
    return _snapshots(_history(spark, sf), [1, 2, 3, 4])


@query(f"WITH {_COMMITS} SELECT version, src, dst, weight FROM n WHERE op <> 'DELETE' AND version IN (2, 4)")
def store_compacted(spark, sf):
    """A version that a transaction of another session holds and the newest one, read after a compaction and a vacuum."""
    store = _history(spark, sf)
    other = Store(spark, store.path)
    other._create("leases/2-held", "2")
    store.compact()
    store.vacuum(0)
    return _snapshots(store, [2, 4])


@query("SELECT CAST(2 AS BIGINT) AS min_active, CAST(2 AS BIGINT) AS active")
def store_active(spark, sf):
    store = _history(spark, sf)
    store._create("leases/2-held", "2")
    return spark.createDataFrame([(store.min_active(), len(store.active()))], "min_active bigint, active bigint")


@query(f"WITH {G2} SELECT 'edge' AS kind, src AS a, dst AS b FROM e WHERE src % 7 <> 0 AND dst % 7 <> 0 UNION ALL SELECT DISTINCT 'vertex' AS kind, src AS a, src AS b FROM e WHERE src % 7 <> 0")
def store_vertex_delete(spark, sf):
    store = Store(spark, scratch(spark))
    graph = fx.g2(spark, sf)
    store.load(graph.vertices, graph.edges)
    store.begin().delete_vertices(graph.vertices.where("v % 7 = 0")).execute()
    now = store.snapshot()
    return now.edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(now.vertices.select(F.lit("vertex").alias("kind"), F.col("v").alias("a"), F.col("v").alias("b")))


@query(f"WITH {G2} SELECT count(*) AS edges, CAST(0 AS BIGINT) AS missing, CAST(0 AS BIGINT) AS extra, CAST(0 AS BIGINT) AS weights, CAST(0 AS BIGINT) AS degrees, CAST(0 AS BIGINT) AS distances FROM e")
def insert_check(spark, sf):
    """All edges go into the store in three commits, in both directions; then the store is compared with them."""
    edges = cut(ids.number_rows(fx.copart(spark, sf, 45), "src", "dst", name="pos"))
    store = Store(spark, scratch(spark))
    streaming.insert_all(store, edges, undirected=True, batches=3)
    graph = store.snapshot()
    found = verify.inserted(graph, edges.drop("pos"), source=edges.agg(F.min("src")).first()[0])
    return graph.edges.agg(F.count("*").alias("edges"), *(F.lit(n).cast("bigint").alias(k) for k, n in found.items()))


@query(f"WITH {G2}, gone AS (SELECT src, dst FROM u WHERE src % 3 = 0) SELECT e.src, e.dst, e.w AS weight FROM e WHERE least(e.src, e.dst) % 3 <> 0")
def store_delete_stream(spark, sf):
    edges = cut(ids.number_rows(fx.copart(spark, sf, 45), "src", "dst", name="pos"))
    store = Store(spark, scratch(spark))
    streaming.insert_all(store, edges, undirected=True)
    streaming.delete_all(store, edges.where("src % 3 = 0"), undirected=True)
    return store.snapshot().edges.select("src", "dst", "weight")


@query(f"WITH {G2} SELECT row_number() OVER (ORDER BY src, dst) - 1 AS pos, src, dst, w AS weight FROM u")
def edge_list_file(spark, sf):
    path = f"{scratch(spark)}/g.edgeList"
    binary.write_edge_list(ids.number_rows(fx.copart(spark, sf, 45), "src", "dst", name="pos"), path, "weighted")
    return binary.read_edge_list(spark, path, "weighted", chunk=1000)


_DENSE = f"{G2}, {VX}, d AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM vx), x AS (SELECT a.i AS src, b.i AS dst FROM e JOIN d a ON e.src = a.v JOIN d b ON e.dst = b.v)"


def _dense(spark, sf):
    graph = fx.g2(spark, sf)
    names = cut(ids.number_rows(graph.vertices, "v", name="id").select(F.col("v").alias("name"), "id"))
    return names.select(F.col("id").alias("v")), cut(ingest.densify(graph.edges.select("src", "dst"), names))


@query(f"WITH {_DENSE} SELECT src, dst FROM x")
def csr_file(spark, sf):
    path = f"{scratch(spark)}/g.csr"
    binary.write_csr(*_dense(spark, sf), path)
    return binary.read_csr(spark, path, chunk=1000)


@query(f"WITH {_DENSE} SELECT src AS v, count(*) AS degree FROM x GROUP BY src")
def csr_bulk_load(spark, sf):
    path = f"{scratch(spark)}/g.csr"
    binary.write_csr(*_dense(spark, sf), path)
    store = Store(spark, scratch(spark))
    store.load_csr(path, lambda src, dst: F.lit(1.0))
    return store.snapshot().degrees()


@query(f"WITH {G2} SELECT count(*) AS edges, count(*) AS places, CAST(0 AS BIGINT) AS least, count(*) - 1 AS greatest, CAST(sum(src) AS BIGINT) AS src, CAST(sum(dst) AS BIGINT) AS dst FROM u")
def edges_shuffled(spark, sf):
    rows = ingest.shuffled(fx.copart(spark, sf, 45))
    return rows.agg(F.count("*").alias("edges"), F.countDistinct("pos").alias("places"), F.min("pos").alias("least"), F.max("pos").alias("greatest"), F.sum("src").alias("src"), F.sum("dst").alias("dst"))


@query(f"WITH {G2} SELECT max(src) + 1 AS top FROM e")
def max_vertex(spark, sf):
    return fx.g2(spark, sf).max_vertex()


def _shares(graph: str, name: str) -> str:
    under = ", ".join(f"avg(CASE WHEN d < {k} THEN 1.0 ELSE 0.0 END) AS {n}" for k, n in ((1, "zero"), (10, "under_10"), (20, "under_20"), (100, "under_100")))
    return f"SELECT '{name}' AS graph, max(d) AS max_degree, {under} FROM (SELECT src, count(*) AS d FROM {graph} GROUP BY src)"


@query(f"WITH {G1}, u2 AS ({fx._U.format(where=' AND a.l_quantity >= 45 AND b.l_quantity >= 45')}), e2 AS (SELECT src, dst FROM u2 UNION ALL SELECT dst, src FROM u2) {_shares('e', 'dense')} UNION ALL {_shares('e2', 'sparse')}")
def degree_reports(spark, sf):
    return verify.degree_reports({"dense": fx.g1(spark, sf).degrees(), "sparse": fx.g2(spark, sf).degrees()})


QUERIES_HERE = {"store_history", "store_compacted", "store_active", "store_vertex_delete", "insert_check", "store_delete_stream", "edge_list_file", "csr_file", "csr_bulk_load", "edges_shuffled", "max_vertex", "degree_reports"}

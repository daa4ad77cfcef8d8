"""The store under several writers and readers, files and their read-back, streams, kernels on plans and in all of their modes, presets and specs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from meshwork import cli, errors
from meshwork import log as edge_log
from meshwork.cut import cut, drop
from meshwork.functions.ids import UNREACHABLE
from meshwork.graph import Graph
from meshwork.kernels import bfs, cdlp, pagerank, sssp
from meshwork.kernels.spread import Dealt
from meshwork.operators import ingest, verify
from meshwork.sources import binary, properties, specs
from meshwork.streaming import edges as streaming
from meshwork.txn import Store


def edges(spark, *rows):
    return spark.createDataFrame(list(rows), "src long, dst long, weight double")


def ids(spark, *rows):
    return spark.createDataFrame([(i,) for i in rows], "v long")


def seen(graph):
    return {(r.src, r.dst): r.weight for r in graph.edges.collect()}


def test_the_second_of_two_writers_loses_and_harms_nothing(spark, tmp_path, monkeypatch):
    a, b = Store(spark, str(tmp_path / "g")), Store(spark, str(tmp_path / "g"))
    a.begin().insert_vertices(ids(spark, 1, 2, 3)).execute()
    now = b.version()
    assert a.begin().insert_edges(edges(spark, (1, 2, 1.0))).execute() == 2
    monkeypatch.setattr(b, "version", lambda: now)  # b has read the version before
    with pytest.raises(errors.CommitConflict):
        b.begin(write_only=True).insert_edges(edges(spark, (2, 3, 9.0))).execute()
    assert seen(a.snapshot()) == {(1, 2): 1.0} and a.version() == 2
    assert len(a._names("edges")) == 2 and not a.vacuum(0)  # the loser's folders are gone


def test_a_reader_of_another_session_keeps_its_version(spark, tmp_path):
    a, b = Store(spark, str(tmp_path / "g")), Store(spark, str(tmp_path / "g"))
    a.begin().insert_vertices(ids(spark, 1, 2)).insert_edges(edges(spark, (1, 2, 1.0))).execute()
    reader = b.begin()
    held = reader.graph()  # a plan made before the compaction
    a.begin().upsert_edges(edges(spark, (1, 2, 2.0))).execute()
    a.begin().upsert_edges(edges(spark, (1, 2, 3.0))).execute()
    assert a.active() == [1, 3] and a.min_active() == 1
    a.compact()
    assert a.vacuum(0) == [] and seen(held) == {(1, 2): 1.0} == seen(reader.graph())
    with pytest.raises(errors.SnapshotGone):
        b.snapshot(2)
    with pytest.raises(errors.IllegalOperation):
        a.drop()
    reader.close()
    with pytest.raises(errors.IllegalOperation):
        reader.close()
    with pytest.raises(errors.IllegalOperation):
        reader.graph()
    for use in (reader.insert_vertices, reader.delete_vertices):
        with pytest.raises(errors.IllegalOperation):
            use(ids(spark, 5))
    before = a.storage()["superseded"]
    assert before > 0 and len(a.vacuum(0)) == 6 and a.storage()["superseded"] == 0
    assert seen(a.snapshot()) == {(1, 2): 3.0}
    a.drop()
    assert a.version() == 0


def test_expired_leases_and_abandoned_files(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"), lease_seconds=0)
    store.begin().insert_vertices(ids(spark, 1)).execute()
    store.begin()
    spark.range(3).write.parquet(str(tmp_path / "g/edges/left-behind"))
    assert store.active() == [1] and store.vacuum(3600) == []
    assert store.vacuum(0) == ["edges/left-behind"] and store._names("leases") == []


def test_vertices_go_with_their_edges(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"))
    store.begin().insert_vertices(ids(spark, 1, 2, 3)).insert_edges(edges(spark, (1, 2, 1.0), (2, 1, 1.0), (3, 1, 1.0))).execute()
    store.begin().delete_vertices(ids(spark, 2)).execute()
    assert seen(store.snapshot()) == {(3, 1): 1.0} and sorted(r.v for r in store.vertices().collect()) == [1, 3]
    assert len(seen(store.snapshot(1))) == 3 and store.vertices(1).count() == 3
    with pytest.raises(errors.VertexDoesNotExist):
        store.begin().delete_vertices(ids(spark, 2)).execute()
    with pytest.raises(errors.VertexDoesNotExist):
        store.begin().delete_vertices(ids(spark, 3)).insert_edges(edges(spark, (1, 3, 1.0))).execute()
    with pytest.raises(errors.IllegalOperation):
        store.begin().delete_vertices(ids(spark, 3)).insert_vertices(ids(spark, 3)).execute()
    store.compact()
    store.begin().insert_vertices(ids(spark, 2)).insert_edges(edges(spark, (1, 2, 5.0))).execute()
    assert seen(store.snapshot()) == {(3, 1): 1.0, (1, 2): 5.0} and store.vertices().count() == 3


def test_compaction_on_write_and_its_report(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"), compact_after=2)
    store.begin().insert_vertices(ids(spark, 1, 2)).insert_edges(edges(spark, (1, 2, 0.0))).execute()
    for k in range(1, 5):
        store.begin().upsert_edges(edges(spark, (1, 2, float(k)))).execute()
    assert seen(store.snapshot()) == {(1, 2): 4.0} and len(store._manifest(store.version())["edges"]) <= 3 and len(store._names("edges")) <= 3
    store.begin().upsert_edges(edges(spark, (1, 2, 9.0))).execute()
    r = verify.compaction(spark, store).first()
    assert r.rows_after == 1 and r.runtime > 0 and seen(store.snapshot()) == {(1, 2): 9.0}


def test_bulk_loads(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"))
    assert store.load(ids(spark, 0, 1, 2), edges(spark, (0, 1, 0.5))) == 1
    with pytest.raises(errors.IllegalOperation):
        store.load(ids(spark, 0), edges(spark))
    (tmp_path / "a.csr").write_bytes(binary.csr_bytes(4, [(2, 0), (0, 1), (0, 3)]))
    other = Store(spark, str(tmp_path / "h"))
    other.load_csr(str(tmp_path / "a.csr"), lambda s, d: (s + d).cast("double"))
    assert seen(other.snapshot()) == {(0, 1): 1.0, (0, 3): 3.0, (2, 0): 2.0} and other.vertices().count() == 4


def test_thousands_of_active_versions(spark):
    log = edge_log.normalise(spark.createDataFrame([(v, "UPSERT", 1, v % 3, float(v)) for v in range(1, 200)], "version long, op string, src long, dst long, weight double"))
    marks = list(range(1, 3000, 1))
    assert edge_log.compact(log, marks).count() == 199
    assert edge_log.compact(log, [100, 5000]).count() == 6


def test_streams(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"))
    rows = spark.createDataFrame([("INSERT", 1, 2), ("DELETE", 1, 2), ("INSERT", 3, 4)], "op string, src long, dst long").coalesce(1)  # without pos and weight
    assert streaming.apply_batch(store, rows, stream="s", batch=4) == 1
    assert streaming.apply_batch(store, rows, stream="s", batch=4) == 1 and store.version() == 1  # a replay
    assert seen(store.snapshot()) == {(3, 4): None}
    streaming.apply_batch(store, rows.limit(1), undirected=True, stream="s", batch=5)
    assert set(seen(store.snapshot())) == {(1, 2), (2, 1), (3, 4)}
    store.compact()
    assert streaming.apply_batch(store, rows, stream="s", batch=5) == store.version() == 3
    assert streaming.insert_all(store, edges(spark).withColumn("pos", F.lit(0)).limit(0)) == []


def test_insert_check_sees_what_is_wrong(spark):
    base = [(1, 2, 1.0), (2, 3, 2.0), (3, 4, 1.0)]
    good = Graph.of_edges(edges(spark, *base))
    assert set(verify.inserted(good, edges(spark, *base), source=1).values()) == {0}
    bad = Graph.of_edges(edges(spark, (1, 2, 1.0), (2, 3, 7.0), (1, 4, 1.0)))
    assert verify.inserted(bad, edges(spark, *base), source=1) == {"missing": 2, "extra": 2, "weights": 2, "degrees": 2, "distances": 1}


def test_gold_is_written_once(spark, tmp_path):
    path = str(tmp_path / "gold")
    rows = spark.createDataFrame([(1, 0.5), (2, 1.5)], "v long, value double")
    assert verify.against_gold(rows, path) is None
    assert verify.against_gold(rows, path).count() == 0
    assert verify.against_gold(rows.withColumn("value", F.col("value") + 1), path).count() == 2


def test_binary_files_by_ranges(spark, tmp_path):
    deal = random.Random(2)
    rows = [(i, deal.randrange(99), deal.randrange(99), deal.random()) for i in range(1000)]
    df = spark.createDataFrame(rows, "pos long, src long, dst long, weight double").repartition(5)
    path = str(tmp_path / "w.edgeList")
    assert binary.write_edge_list(df, path, "weighted") == 1000
    got = binary.read_edge_list(spark, path, "weighted", chunk=64)
    assert got.rdd.getNumPartitions() > 1 and sorted(map(tuple, got.collect())) == rows
    (tmp_path / "two").mkdir()
    for k in "ab":
        (tmp_path / "two" / k).write_bytes(binary.edge_list_bytes([(1, 2), (3, 4)]))
    assert sorted(r.pos for r in binary.read_edge_list(spark, str(tmp_path / "two")).collect()) == [0, 1, 2, 3]
    (tmp_path / "short.edgeList").write_bytes(binary.edge_list_bytes([(1, 2)])[:-1])
    with pytest.raises(ValueError, match="bytes"):
        binary.read_edge_list(spark, str(tmp_path / "short.edgeList"))
    hub = edges(spark, *[(1, i, 1.0) for i in range(40)], (3, 0, 1.0))
    assert binary.write_csr(spark.range(40).toDF("v"), hub, str(tmp_path / "h.csr")) == (40, 41)
    assert binary.read_csr(spark, str(tmp_path / "h.csr"), chunk=7).exceptAll(hub.select("src", "dst")).count() == 0
    with pytest.raises(ValueError, match="0..V-1"):
        binary.write_csr(ids(spark, 1, 2), hub, str(tmp_path / "x.csr"))
    assert binary.write_csr(ids(spark), edges(spark), str(tmp_path / "e.csr")) == (0, 0) and binary.read_csr(spark, str(tmp_path / "e.csr")).count() == 0


def test_weights_and_shuffles_repeat(spark):
    rows = spark.createDataFrame([(i, i * 7 % 100) for i in range(1, 100)], "src long, dst long")
    one = {(r.src, r.dst): r.weight for r in ingest.with_weights(rows).collect()}
    assert one == {(r.dst, r.src): r.weight for r in ingest.with_weights(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).collect()}
    assert all(0.01 <= w < 1 for w in one.values()) and len(set(one.values())) > 90
    order = lambda seed: [(r.src, r.dst) for r in ingest.shuffled(rows.repartition(3), seed).orderBy("pos").collect()]
    assert order(1) == order(1) != order(2) and sorted(order(1)) == sorted(one)


def test_presets_specs_and_commands(spark, tmp_path):
    assert specs.parse("bfs, pr(5'0.85),x( )") == [specs.Spec("bfs"), specs.Spec("pr", ("5", "0.85")), specs.Spec("x")]
    for bad in ("", "a,,b", "a(", "a)b", "a(b)c", "(x)"):
        with pytest.raises(ValueError):
            specs.parse(bad)
    assert specs.preset("updates") == (0.1, 0.1)
    with pytest.raises(ValueError):
        specs.preset("none")
    with pytest.raises(FileNotFoundError):
        properties.checked(str(tmp_path / "no.csr"), spark)
    with pytest.raises(ValueError):
        properties.checked("x.txt")
    p = cli.with_specs(properties.AlgoParams(), "bfs(3),cdlp(4),pr(7'0.5),wcc")
    assert (p.bfs_source, p.cdlp_iterations, p.pr_iterations, p.pr_damping, p.algorithms) == (3, 4, 7, 0.5, ["bfs", "cdlp", "pr", "wcc"])
    with pytest.raises(ValueError):
        cli.with_specs(p, "dance")
    (tmp_path / "e.txt").write_text("\n".join(f"a{i} a{(i * 7 + 1) % 40}" for i in range(40)))
    with pytest.raises(ValueError, match="densify"):
        cli.main(["convert", str(tmp_path / "e.txt"), str(tmp_path / "out")])
    cli.main(["convert", str(tmp_path / "e.txt"), str(tmp_path / "out"), "--densify", "--preset", "updates", "--make_undirected"])
    n = lambda name: spark.read.parquet(str(tmp_path / "out" / name)).count()
    assert n("insertions") == n("deletions") == int(0.1 * (n("base") / 2 + n("insertions")))
    for _ in range(2):  # the first run writes the gold values, the second is held against them
        cli.main(["run", str(tmp_path / "out/base"), str(tmp_path / "report"), "--experiments", "wcc,pr(3)", "--repetitions", "1", "--gold", str(tmp_path / "gold")])
    binary.write_edge_list(spark.createDataFrame([(i, i, i + 1) for i in range(20)], "pos long, src long, dst long"), str(tmp_path / "s.edgeList"))
    cli.main(["insert", str(tmp_path / "s.edgeList"), str(tmp_path / "g"), "--undirected", "--batches", "2", "--check"])
    cli.main(["compact", str(tmp_path / "g")])
    assert Store(spark, str(tmp_path / "g")).snapshot().edge_count() == 40


def moved(df):
    """The exchanges of a plan by the key of the edges (which has a salt), before adaptive execution, and the plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if re.search(r"Exchange hashpartitioning\(.*salt.*ENSURE", line)], plan


def test_rounds_do_not_move_the_edges(spark):
    pairs = edges(spark, *[(i, (i * 5 + 1) % 200, 1.0) for i in range(200)])
    graph = Graph.of_edges(pairs)
    hops = Dealt(graph.edges.select("src", "dst"), "src")
    state = cut(graph.vertices.join(hops.degree, "v", "left").select("v", F.coalesce("deg", F.lit(0)).alias("deg"), F.lit(0.005).alias("score")))
    found, plan = moved(pagerank.step(hops, state, 200, 0.85))
    assert len(found) == 1 and "InMemoryTableScan" in plan  # of the state alone
    hops = Dealt(graph.edges.select("src", "dst"), "dst")
    state = cut(hops.degree.select("v", "deg", F.col("v").alias("label"), F.lit(True).alias("changed")))
    found, plan = moved(cdlp.step(hops, state))
    assert len(found) == 1 and "InMemoryTableScan" in plan


def test_hubs_are_dealt_over_salts(spark):
    star = Graph.of_edges(edges(spark, *[(0, i, 1.0) for i in range(1, 400)], (5, 6, 1.0)))
    hops = Dealt(star.edges.select("src", "dst"), "src", hub=50)
    sizes = {(r.src, r.salt): r["count"] for r in hops.edges.groupBy("src", "salt").count().collect()}
    assert sum(n for (s, _), n in sizes.items() if s == 0) == 399 and max(sizes.values()) < 100
    assert hops.join(hops.degree).count() == star.edge_count()
    hops.free()


@pytest.mark.parametrize(("narrow", "held"), [(10_000, 5), (3, 5), (0, 5)])
def test_searches_in_every_mode(spark, narrow, held):
    deal = random.Random(narrow + held)
    pairs = {(deal.randrange(80), deal.randrange(80)) for _ in range(110)} | {(100 + i, 101 + i) for i in range(6)}
    weights = {p: 0.25 * deal.randrange(1, 9) for p in pairs}
    for symmetric in (True, False):
        both = dict(weights) | ({(b, a): w for (a, b), w in weights.items()} if symmetric else {})
        e = edges(spark, *[(a, b, w) for (a, b), w in both.items()])
        v = e.select(F.col("src").alias("v")).union(e.select("dst")).distinct()
        source = min(a for a, _ in both)
        hops, far = {source: 0}, {source: 0.0}
        for _ in range(200):
            for (a, b), w in both.items():
                if a in hops and hops[a] + 1 < hops.get(b, 1e9):
                    hops[b] = hops[a] + 1
                if a in far and far[a] + w < far.get(b, 1e9):
                    far[b] = far[a] + w
        got = {r.v: r.distance for r in bfs.bfs(v, e, source, symmetric=symmetric, narrow=narrow, held=held).collect()}
        assert got == {r.v: hops.get(r.v, UNREACHABLE) for r in v.collect()}
        for delta in (None, 0.5):
            got = {r.v: r.distance for r in sssp.sssp(v, e, source, delta=delta, narrow=narrow, held=held).collect()}
            assert got == {r.v: far.get(r.v, float("inf")) for r in v.collect()}
    assert {r.distance for r in bfs.bfs(v, e, -5).collect()} == {UNREACHABLE}


def test_dropped_checkpoints_are_gone(spark):
    import os

    df = cut(spark.range(10))
    path = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile().get().removeprefix("file:")
    assert os.path.isdir(path)
    drop(df)
    assert not os.path.isdir(path)
    drop(spark.range(3))  # not cut: nothing happens

import math
import random

import pytest
from pyspark.sql import functions as F

from meshwork import errors
from meshwork import log as edge_log
from meshwork.functions.ids import INT64_MAX, UNREACHABLE, next_power_of_two, number_rows
from meshwork.graph import Graph
from meshwork.kernels.wcc import components
from meshwork.operators import ingest, report
from meshwork.sources import binary, properties, text
from meshwork.streaming import edges as streaming
from meshwork.txn import Store


def graph(spark, pairs, extra=(), weight=1.0):
    g = Graph.of_edges(spark.createDataFrame([(a, b, weight) for a, b in pairs], "src long, dst long, weight double"))
    return Graph(g.vertices.unionByName(spark.createDataFrame([(x,) for x in extra], "v long")), g.edges)


def rows(df):
    return {tuple(r)[0]: tuple(r)[1] for r in df.collect()}


def test_triangle_with_tail(spark):
    assert rows(graph(spark, [(1, 2), (2, 3), (1, 3), (3, 4)]).lcc()) == {1: 1.0, 2: 1.0, 3: pytest.approx(1 / 3), 4: 0.0}


def test_path_and_isolated(spark):
    g = graph(spark, [(1, 2), (2, 3), (3, 4), (4, 5)], [9])
    assert rows(g.bfs(1)) == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 9: UNREACHABLE}
    assert rows(g.bfs(1, symmetric=False)) == rows(g.bfs(1))
    assert rows(g.sssp(1)) == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4, 9: math.inf} == rows(g.sssp(1, delta=2.0))
    assert rows(g.wcc()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 9: 9}
    assert sum(rows(g.pagerank(5)).values()) == pytest.approx(1)
    assert g.source_candidate().collect()[0][0] == 1
    assert rows(g.cdlp(1))[9] == INT64_MAX and rows(g.cdlp(1, "self"))[9] == 9


def test_cdlp_takes_the_smallest_of_equals(spark):
    assert rows(graph(spark, [(0, 5), (0, 6), (0, 7)]).cdlp(1))[0] == 5


@pytest.mark.parametrize("seed", [0, 1])
def test_components_of_random_graphs(spark, seed):
    deal = random.Random(seed)
    pairs = [(deal.randrange(300), deal.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(70)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = rows(components(spark.createDataFrame(pairs, "src long, dst long")))
    assert got == {v: find(v) for v in parent}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_reads(spark):
    g = graph(spark, [(1, 2), (2, 3), (1, 3), (3, 4)])
    assert (g.vertex_count(), g.edge_count(), g.property_size()) == (4, 8, 8)
    want = spark.createDataFrame([(1, 2), (4, 1), (9, 1)], "src long, dst long")
    assert {(r.src, r.dst): r.present for r in g.has_edges(want).collect()} == {(1, 2): True, (4, 1): False, (9, 1): False}
    assert g.weights(want).count() == 1
    with pytest.raises(errors.NoProperties):
        Graph(g.vertices, g.edges.drop("weight")).weights(want)
    assert [tuple(r) for r in g.intersect(spark.createDataFrame([(1, 2)], "a long, b long")).collect()] == [(1, 2, 3)]


def test_dirty_text(spark, tmp_path):
    (tmp_path / "e.txt").write_text("% c\n2 1 5\n1 2 7\n3 3 1\n# x\n1 2 0.9\n")
    e = text.read_edges(spark, str(tmp_path / "e.txt"), "weighted")
    assert [(r.src, r.dst, r.weight) for r in ingest.clean(e).collect()] == [(1, 2, 5.0)]
    with pytest.raises(ValueError):
        text.separator(spark.createDataFrame([(0, "abc")], "pos long, value string"))


def test_binary_files(spark, tmp_path):
    (tmp_path / "a.edgeList").write_bytes(binary.edge_list_bytes([(1, 2, 0.5), (3, 4, 1.5)], "weighted"))
    assert [tuple(r) for r in binary.read_edge_list(spark, str(tmp_path / "a.edgeList"), "weighted").collect()] == [(0, 1, 2, 0.5), (1, 3, 4, 1.5)]
    (tmp_path / "b.csr").write_bytes(binary.csr_bytes(4, [(2, 0), (0, 1), (0, 3)]))
    assert sorted(map(tuple, binary.read_csr(spark, str(tmp_path / "b.csr")).collect())) == [(0, 1), (0, 3), (2, 0)]
    (tmp_path / "c.csr").write_bytes(binary.csr_bytes(4, [(2, 0)]) + b"x")
    with pytest.raises(Exception, match="bytes"):
        binary.read_csr(spark, str(tmp_path / "c.csr")).collect()
    (tmp_path / "gold").write_text("1 3\n2 99999999999\n3 18446744073709551615\n")
    assert rows(binary.read_gold(spark, str(tmp_path / "gold"))) == {1: 3, 2: UNREACHABLE, 3: UNREACHABLE}


def test_properties():
    p = properties.parse("# c\ngraph.x.vertices = 5\ngraph.x.algorithms = bfs, pr\ngraph.x.pr.num-iterations=7\ngraph.x.edge-properties.names = weight\n")
    assert (p.vertices, p.pr_iterations, p.weighted, p.experiments()) == (5, 7, True, ["bfs", "bsbfs", "pr", "bspr"])
    with pytest.raises(ValueError):
        properties.parse("graph.x.directed = true")
    assert properties.Dataset("/d/wiki-u").undirected and properties.checked("/d/a.csr")


def test_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert number_rows(df.repartition(7), "k").where("k <> idx").count() == 0
    assert number_rows(df.limit(0), "k").count() == 0
    assert [r[0] for r in spark.createDataFrame([(1,), (3,), (8,)], "x long").select(next_power_of_two(F.col("x"))).collect()] == [1, 4, 8]


def replay(ops, version):
    state = {}
    for v, op, s, d, w in ops:
        if v <= version:
            if op == "DELETE":
                state.pop((s, d), None)
            elif op == "UPSERT" or (s, d) not in state:
                state[s, d] = w
    return state


def test_log_against_replay_at_every_version(spark):
    deal = random.Random(3)
    ops = [(v, deal.choice(["INSERT", "INSERT", "UPSERT", "DELETE"]), deal.randrange(3), deal.randrange(3), float(v)) for v in range(1, 41)]
    log = edge_log.normalise(spark.createDataFrame(ops, "version long, op string, src long, dst long, weight double")).cache()
    active = [7, 19, 30]
    small = edge_log.compact(log, active).cache()
    assert small.count() <= log.count()
    for v in range(0, 42):
        state = {(r.src, r.dst): r.weight for r in edge_log.snapshot(log, v).collect()}
        assert state == replay(ops, v)
        if v in active or v >= 30:
            assert {(r.src, r.dst): r.weight for r in edge_log.snapshot(small, v).collect()} == state
    with pytest.raises(errors.SnapshotGone):
        edge_log.readable(8, active)


def test_transactions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "g"))
    e = lambda *x: spark.createDataFrame(list(x), "src long, dst long, weight double")
    v = lambda *x: spark.createDataFrame([(i,) for i in x], "v long")
    seen = lambda g: {(r.src, r.dst): r.weight for r in g.edges.collect()}
    with pytest.raises(errors.VertexDoesNotExist):
        store.begin().insert_edges(e((1, 2, 1.0))).execute()
    assert store.version() == 0
    assert store.begin().insert_vertices(v(1, 2, 3)).insert_edges(e((1, 2, 1.0))).execute() == 1
    with pytest.raises(errors.EdgeExists):
        store.begin().insert_edges(e((1, 2, 1.0))).execute()
    with pytest.raises(errors.EdgeExists):
        store.begin().delete_edges(e((1, 2, 1.0))).insert_edges(e((1, 2, 5.0))).execute()
    with pytest.raises(errors.EdgeDoesNotExist):
        store.begin().delete_edges(e((2, 3, 1.0))).execute()
    reader = store.begin()
    assert store.begin(relaxed_edges=True).delete_edges(e((1, 2, 1.0))).insert_edges(e((1, 2, 5.0), (2, 3, 2.0))).execute() == 2
    assert store.begin().upsert_edges(e((2, 3, 9.0))).execute() == 3
    assert seen(reader.graph()) == {(1, 2): 1.0} and seen(store.snapshot()) == {(1, 2): 5.0, (2, 3): 9.0}
    assert store.active() == [1, 3] and store.min_active() == 1
    store.compact()
    assert seen(store.snapshot(1)) == {(1, 2): 1.0} and seen(store.snapshot()) == {(1, 2): 5.0, (2, 3): 9.0}
    with pytest.raises(errors.SnapshotGone):
        store.snapshot(2)
    with pytest.raises(errors.IllegalOperation):
        store.begin(write_only=True).graph()

    def fails(g):
        raise errors.IllegalOperation("no")

    with pytest.raises(errors.IllegalOperation):
        store.begin().require(fails).insert_vertices(v(9)).execute()
    with pytest.raises(errors.CommitConflict):
        store._publish(store.version(), {})
    assert store.storage()["edges"] > 0


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([(1, "INSERT", 1, 2, 1.0), (2, "INSERT", 2, 3, 1.0), (3, "DELETE", 1, 2, 0.0)], "pos long, op string, src long, dst long, weight double").coalesce(1).write.parquet(str(src))
    store = Store(spark, str(tmp_path / "g"))
    stream = spark.readStream.schema("pos long, op string, src long, dst long, weight double").parquet(str(src))
    streaming.ingest(stream, store, str(tmp_path / "ck")).awaitTermination()
    assert [(r.src, r.dst) for r in store.snapshot().edges.collect()] == [(2, 3)]


def test_report_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text("# note\nexecution_id;timestamp;repetition;dataset;experiment;data_structure;runtime;storage;\n1;5;0;a/g/x;bfs;csr;100;;\n1;6;3;a/g/x;bfs;csr;90;;\n")
    df = report.read(spark, str(tmp_path / "r.csv"))
    assert [r.runtime for r in report.warm(df).collect()] == [90]
    assert report.next_execution_id(df).first()[0] == 2
    gold = spark.createDataFrame([(1, math.inf), (2, 1.0), (3, 1.0)], "v long, value double")
    got = spark.createDataFrame([(1, math.inf), (2, 1.00001), (4, 1.0)], "v long, value double")
    assert sorted(r.v for r in report.compare(got, gold).collect()) == [3, 4]


def test_convert_and_run(spark, tmp_path):
    from meshwork import cli

    (tmp_path / "e.txt").write_text("# x\n" + "\n".join(f"a{i} a{(i * 7 + 1) % 40} {100 - i}" for i in range(40)))
    out = str(tmp_path / "out")
    cli.convert(spark, str(tmp_path / "e.txt"), out, kind="temporal", densify=True, insert=0.1, delete=0.1, undirected=True)
    n = lambda p: spark.read.parquet(f"{out}/{p}").count()
    assert spark.read.parquet(f"{out}/offsets").agg(F.max("end")).first()[0] == n("base")
    for _ in range(2):
        cli.run_suite(spark, f"{out}/base", properties.AlgoParams(algorithms=["bfs", "pr"], bfs_source=0), 1, str(tmp_path / "report"))
    assert sorted(r.execution_id for r in spark.read.parquet(str(tmp_path / "report")).collect()) == [1, 1, 2, 2]

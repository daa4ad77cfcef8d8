import os
import random

import pytest
from pyspark.sql import functions as F

from meshwork.cut import CLEANUP
from meshwork.kernels.lcc import lcc, triangle_count, triangles


def dealt(n, m, seed=5):
    """Edges with src < dst in no order, of a graph with a hub, doubled in part, and the brute force's triangles."""
    deal = random.Random(seed)
    pairs = {(a, b) for a, b in ((deal.randrange(n), deal.randrange(n)) for _ in range(m)) if a < b} | {(0, i) for i in range(1, n, 2)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    found = {(a, b, c) for a, b in pairs for c in near[a] & near[b] if c > b}
    return sorted(pairs) + sorted(pairs)[: m // 10], near, found


def written(spark):
    """Bytes that this session has written to shuffles."""
    each = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(each.apply(i).totalShuffleWrite() for i in range(each.size()))


@pytest.mark.parametrize("block_bytes,degree_bytes", [(1 << 26, 1 << 26), (2000, 0)])
def test_blocks_equal_brute_force(spark, block_bytes, degree_bytes):
    pairs, near, found = dealt(120, 900)
    once = spark.createDataFrame([(a + (1 << 40), b + (1 << 40)) for a, b in pairs], "src long, dst long")
    both = once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).unionByName(spark.createDataFrame([(7, 7), (8, None)], "src long, dst long"))
    how = {"block_bytes": block_bytes, "degree_bytes": degree_bytes}
    for edges, only in ((once, True), (both, False)):
        rows = [tuple(r) for r in triangles(edges, once=only, **how).collect()]
        assert sorted(tuple(sorted(x - (1 << 40) for x in r)) for r in rows) == sorted(found)
        assert triangle_count(edges, once=only, **how) == len(found)
        at = {v: 0 for v in near}
        for t in found:
            for x in t:
                at[x] += 1
        want = {v + (1 << 40): pytest.approx(2 * at[v] / (len(near[v]) * (len(near[v]) - 1)) if len(near[v]) > 1 else 0.0) for v in near}
        assert {r.v: r.lcc for r in lcc(None, edges, once=only, **how).collect()} == want
        assert {r.v: r.lcc for r in lcc(spark.createDataFrame([(3,), ((1 << 40) + 1,)], "v long"), edges, once=only, **how).collect()} == {3: 0.0, (1 << 40) + 1: want[(1 << 40) + 1]}
    none = once.limit(0)
    assert triangles(none).count() == triangle_count(none) == lcc(None, none).count() == 0


def test_wedges_are_not_shuffled_and_nothing_stays(spark):
    pairs, _, found = dealt(2000, 60_000)
    edges = spark.createDataFrame(pairs, "src long, dst long")
    edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).repartition(4).cache()
    edges.count()
    threshold, cleanup, began = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get(CLEANUP, None), written(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert triangles(edges).agg(F.count("*")).first()[0] == len(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        edges.unpersist()
    assert written(spark) - began < 60 * len(pairs)  # with the neighbour arrays of both ends it was over 100
    assert spark.conf.get(CLEANUP, None) == cleanup
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    assert not [f for _, _, names in os.walk(shared) for f in names if f.endswith(".parquet")]


def test_the_query_leaves_no_checkpoint_of_its_edges(spark):
    from meshwork.cut import ensure_checkpoint_dir
    from meshwork.plans import catalog

    ensure_checkpoint_dir(spark)
    shared = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(os.listdir(shared))
    assert catalog.QUERIES["triangles"](spark, "/root/testdata/sf0.001").first()[0] > 0
    assert set(os.listdir(shared)) <= before


def test_search_in_small_pieces(monkeypatch):
    """Shards of few edges, few wedges at a time and a crowded index find the same."""
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from meshwork.kernels import lcc as kernel

    pairs, _, found = dealt(150, 2500)
    near = {}
    for a, b in sorted(set(pairs)):
        near.setdefault(a - 75, []).append(b - 75)  # negative ids, too
    table = pa.record_batch([pa.array(list(near), pa.int64()), pa.array(list(near.values()), pa.list_(pa.int64()))], names=["a", "near"])
    for edges, bits, wedges in ((1, 3, 1), (40, 5, 7), (1 << 16, 21, 1 << 20)):
        for name, value in (("SHARD_EDGES", edges), ("SLOT_BITS", bits), ("WEDGES", wedges)):
            monkeypatch.setattr(kernel, name, value)
        got = []
        for sent in (table.slice(0, 60), table.slice(60), table.slice(0, 0)):
            search = kernel._search(SimpleNamespace(value=kernel._lists(sent.column(0), sent.column(1))))
            got += [t for shard in kernel._shards([table.slice(0, 80), table.slice(80)]) for x in search(shard) for t in zip(*(y.tolist() for y in x), strict=True)]
        assert sorted(got) == sorted((a - 75, b - 75, c - 75) for a, b, c in found)
        counts = list(kernel._ends(iter([tuple(np.array(x, np.int64) for x in zip(*got, strict=True))])))
        assert sum(int(t.sum()) for _, t in counts) == 3 * len(found)

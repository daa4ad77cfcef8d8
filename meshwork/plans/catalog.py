"""The queries, each with the SQL that says the same over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork import log as edge_log
from meshwork.cut import cut
from meshwork.functions import ids
from meshwork.graph import Graph
from meshwork.kernels.lcc import lcc as clustering
from meshwork.kernels.lcc import triangle_count
from meshwork.operators import ingest, report
from meshwork.plans import fixtures as fx
from meshwork.sources import text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def _big(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def _first(graph: Graph) -> int:
    return graph.vertices.agg(F.min("v")).first()[0]


G2, G1, VX, PARTS, LOG, RAW, RUNS = fx.G2, fx.G1, fx.VX, fx.PARTS, fx.LOG, fx.RAW, fx.RUNS

# --- text and cleaning

_EV = "ev AS (SELECT event_id AS pos, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value, ts FROM events)"


@query(f"WITH {_EV} SELECT pos, user_id AS src, k AS dst FROM ev WHERE pos % 10 <> 0")
def text_parse_plain(spark, sf):
    rows = fx.text_lines(spark, sf)
    return text.parse(rows, text.separator(rows))


@query(f"WITH {_EV} SELECT pos, user_id AS src, k AS dst, value AS weight FROM ev WHERE pos % 10 <> 0")
def text_parse_weighted(spark, sf):
    rows = fx.text_lines(spark, sf)
    return text.parse(rows, text.separator(rows), "weighted")


@query(f"WITH {_EV} SELECT pos, user_id AS src, k AS dst, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM ev WHERE pos % 10 <> 0")
def text_parse_temporal(spark, sf):
    rows = fx.text_lines(spark, sf, temporal=True)
    return text.parse(rows, text.separator(rows), "temporal")


@query("SELECT CAST(count(*) AS BIGINT) AS lines, CAST(count(*) FILTER (event_id % 10 <> 0) AS BIGINT) AS data_lines FROM events")
def comment_filter(spark, sf):
    rows = fx.text_lines(spark, sf)
    return rows.agg(_big(F.count("*")).alias("lines"), _big(F.count_if(~F.col("value").rlike(text.COMMENT))).alias("data_lines"))


def _event_edges(spark, sf):
    """Edges with loops, doubles and both directions: users modulo 50 and keys modulo 50."""
    return fx.raw_log(spark, sf).select(F.col("version").alias("pos"), (F.col("src") % 50).alias("src"), ((F.col("dst") - 1000000) % 50).alias("dst"), "weight")


_DIRTY = "ev AS (SELECT event_id AS pos, user_id % 50 AS src, CAST(json_extract_string(props, '$.k') AS BIGINT) % 50 AS dst, value AS weight FROM events)"


@query(f"WITH {_DIRTY}, c AS (SELECT pos, least(src, dst) AS src, greatest(src, dst) AS dst, weight FROM ev WHERE src <> dst) SELECT src, dst, pos, weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY pos) AS r FROM c) WHERE r = 1")
def edges_clean_dedup(spark, sf):
    return ingest.clean(_event_edges(spark, sf))


@query(f"WITH {_DIRTY} SELECT pos, src, dst, weight FROM ev WHERE src <> dst")
def self_loop_filter(spark, sf):
    return ingest.without_loops(_event_edges(spark, sf))


@query(f"WITH {_DIRTY} SELECT pos, least(src, dst) AS src, greatest(src, dst) AS dst, weight FROM ev")
def edges_canonical(spark, sf):
    return ingest.canonical(_event_edges(spark, sf))


@query(f"WITH {G1} SELECT src, dst, round(w, 6) AS weight FROM e")
def edges_undirected(spark, sf):
    return ingest.symmetric(fx.copart(spark, sf)).withColumn("weight", F.round("weight", 6))


_NAMED = "ev AS (SELECT event_id AS pos, 'u' || CAST(user_id AS VARCHAR) AS src, 'k' || json_extract_string(props, '$.k') AS dst FROM events)"
_DICT = f"{_NAMED}, seen AS (SELECT src AS name, pos * 2 AS place FROM ev UNION ALL SELECT dst, pos * 2 + 1 FROM ev), d AS (SELECT name, row_number() OVER (ORDER BY min(place), name) - 1 AS id FROM seen GROUP BY name)"


def _named(spark, sf):
    return fx.table(spark, sf, "events").select(F.col("event_id").alias("pos"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("src"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("dst"))


@query(f"WITH {_DICT} SELECT name, CAST(id AS BIGINT) AS id FROM d")
def densify_dictionary(spark, sf):
    return ingest.dictionary(_named(spark, sf))


@query(f"WITH {_DICT} SELECT CAST(a.id AS BIGINT) AS src, CAST(b.id AS BIGINT) AS dst, pos FROM ev JOIN d a ON ev.src = a.name JOIN d b ON ev.dst = b.name")
def densify_edges(spark, sf):
    rows = _named(spark, sf)
    return ingest.densify(rows, ingest.dictionary(rows))


@query(f"WITH {G2} SELECT count(DISTINCT src) AS vertices FROM e")
def vertex_count_distinct(spark, sf):
    return ingest.symmetric(fx.copart(spark, sf, 45)).agg(F.countDistinct("src").alias("vertices"))


# --- layout and degrees

_DEG = "dg AS (SELECT v, count(e.dst) AS degree FROM vx LEFT JOIN e ON e.src = vx.v GROUP BY v)"


@query(f"WITH {G2}, {PARTS}, {_DEG} SELECT v, CAST(sum(degree) OVER (ORDER BY v) - degree AS BIGINT) AS \"begin\", CAST(sum(degree) OVER (ORDER BY v) AS BIGINT) AS \"end\" FROM dg")
def csr_offsets(spark, sf):
    g = fx.g2(spark, sf, all_parts=True)
    return ingest.csr_offsets(g.vertices, g.edges).select("v", _big("begin").alias("begin"), _big("end").alias("end"))


@query(f"WITH {G2}, {PARTS}, {_DEG} SELECT v, degree FROM dg")
def degree_all(spark, sf):
    return fx.g2(spark, sf, all_parts=True).degrees()


@query(f"WITH {G1}, {VX}, {_DEG}, b AS (SELECT CAST(degree // 30 AS BIGINT) AS bin, count(*) AS vertices FROM dg GROUP BY 1) SELECT bin, vertices FROM b")
def degree_histogram(spark, sf):
    return ingest.degree_histogram(fx.g1(spark, sf).degrees()).select("bin", "vertices")


@query(f"WITH {G1}, {VX}, {_DEG}, b AS (SELECT CAST(degree // 30 AS BIGINT) AS bin, count(*) AS n FROM dg GROUP BY 1) SELECT bin, round(sum(n) OVER (ORDER BY bin) / sum(n) OVER (), 6) AS cdf FROM b")
def degree_cdf(spark, sf):
    return ingest.degree_histogram(fx.g1(spark, sf).degrees()).select("bin", F.round("cdf", 6).alias("cdf"))


@query(f"WITH {G2}, {PARTS}, {_DEG} SELECT max(degree) AS max_degree, round(avg(CASE WHEN degree < 1 THEN 1.0 ELSE 0 END), 6) AS zero, round(avg(CASE WHEN degree < 10 THEN 1.0 ELSE 0 END), 6) AS under_10, round(avg(CASE WHEN degree < 20 THEN 1.0 ELSE 0 END), 6) AS under_20, round(avg(CASE WHEN degree < 100 THEN 1.0 ELSE 0 END), 6) AS under_100 FROM dg")
def degree_characteristics(spark, sf):
    r = ingest.degree_characteristics(fx.g2(spark, sf, all_parts=True).degrees())
    return r.select("max_degree", *(F.round(c, 6).alias(c) for c in r.columns[1:]))


@query(f"WITH {G1} SELECT max(n) AS max_degree FROM (SELECT count(*) AS n FROM e GROUP BY src)")
def max_degree(spark, sf):
    return ingest.symmetric(fx.copart(spark, sf)).groupBy("src").count().agg(F.max("count").alias("max_degree"))


# --- splits

_ORD = f"{G2}, o AS (SELECT src, dst, row_number() OVER (ORDER BY (src * 7919 + dst * 104729) % 1000003, src, dst) - 1 AS i, count(*) OVER () AS n FROM u)"


def _split(spark, sf):
    return ingest.split(cut(fx.copart(spark, sf, 45)), 0.1, 0.1, (F.col("src") * 7919 + F.col("dst") * 104729) % 1000003, "src", "dst")


@query(f"WITH {_ORD} SELECT src, dst FROM o WHERE i >= n - CAST(floor(0.1 * n) AS BIGINT)")
def split_insert(spark, sf):
    return _split(spark, sf)[1].select("src", "dst")


@query(f"WITH {_ORD} SELECT src, dst FROM o WHERE i < CAST(floor(0.1 * n) AS BIGINT)")
def split_delete(spark, sf):
    return _split(spark, sf)[2].select("src", "dst")


@query(f"WITH {_ORD} SELECT src, dst FROM o WHERE i < n - CAST(floor(0.1 * n) AS BIGINT)")
def split_base(spark, sf):
    return _split(spark, sf)[0].select("src", "dst")


@query(f"WITH {RAW}, o AS (SELECT version, src, dst, row_number() OVER (ORDER BY ts, event_id) - 1 AS i, count(*) OVER () AS n FROM raw JOIN events ON event_id = version) SELECT version, src, dst FROM o WHERE i >= n - CAST(floor(0.1 * n) AS BIGINT)")
def temporal_tail(spark, sf):
    rows = fx.raw_log(spark, sf).join(fx.table(spark, sf, "events").select(F.col("event_id").alias("version"), "ts"), "version")
    return ingest.split(rows, 0.1, 0, "ts", "version")[1].select("version", "src", "dst")


@query(f"WITH {RAW} SELECT version, ts, row_number() OVER (ORDER BY ts DESC, version DESC) - 1 AS pos FROM raw JOIN events ON event_id = version")
def temporal_sort(spark, sf):
    rows = fx.raw_log(spark, sf).join(fx.table(spark, sf, "events").select(F.col("event_id").alias("version"), "ts"), "version").select("version", "ts")
    return ids.number_rows(rows, F.desc("ts"), F.desc("version"), name="pos")


@query(f"WITH {G2} SELECT src, dst, round(0.01 + 0.99 * ((src * 7919 + dst * 104729) % 1000003) / 1000003.0, 6) AS weight FROM u")
def weight_assign(spark, sf):
    w = F.round(0.01 + 0.99 * ((F.col("src") * 7919 + F.col("dst") * 104729) % 1000003) / F.lit(1000003.0), 6)
    return ingest.with_weights(fx.copart(spark, sf, 45), w).select("src", "dst", "weight")


# --- reads

@query(f"WITH {G1} SELECT count(DISTINCT src) AS vertices FROM e")
def vertex_count(spark, sf):
    g = fx.g1(spark, sf)
    return g.vertices.agg(F.count("*").alias("vertices"))


@query(f"WITH {G1} SELECT count(*) AS edges FROM e")
def edge_count(spark, sf):
    return ingest.symmetric(fx.copart(spark, sf)).agg(F.count("*").alias("edges"))


@query(f"WITH {G2} SELECT p_partkey AS v, p_partkey IN (SELECT src FROM e) AS present FROM part")
def has_vertex_batch(spark, sf):
    return fx.g2(spark, sf).has_vertices(fx.table(spark, sf, "part").select(F.col("p_partkey").alias("v")))


_PROBES = "pr AS (SELECT DISTINCT l_partkey AS src, (l_partkey + l_linenumber) % 97 AS dst FROM lineitem UNION SELECT src, dst FROM u WHERE src % 3 = 0)"


def _probes(spark, sf, g):
    a = fx.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), ((F.col("l_partkey") + F.col("l_linenumber")) % 97).alias("dst"))
    return a.unionByName(g.edges.where("src < dst AND src % 3 = 0").select("src", "dst")).distinct()


@query(f"WITH {G2}, {_PROBES} SELECT pr.src, pr.dst, e.src IS NOT NULL AS present FROM pr LEFT JOIN e ON e.src = pr.src AND e.dst = pr.dst")
def has_edge_batch(spark, sf):
    g = fx.g2(spark, sf)
    return g.has_edges(_probes(spark, sf, g))


@query(f"WITH {G2}, {_PROBES} SELECT src, dst, round(w, 6) AS weight FROM pr JOIN e USING (src, dst)")
def get_weight_batch(spark, sf):
    g = fx.g2(spark, sf)
    return g.weights(_probes(spark, sf, g)).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {G2}, {VX}, {_DEG} SELECT v, degree FROM dg")
def degree(spark, sf):
    return fx.g2(spark, sf).degrees()


@query(f"WITH {G2} SELECT src, dst FROM e WHERE src % 10 = 3")
def neighbours_of(spark, sf):
    g = fx.g2(spark, sf)
    return g.neighbours(g.vertices.where("v % 10 = 3")).select("src", "dst")


@query(f"WITH {G2} SELECT src, dst, round(w, 6) AS weight FROM e WHERE src % 10 = 3")
def neighbours_weighted(spark, sf):
    g = fx.g2(spark, sf)
    return g.neighbours(g.vertices.where("v % 10 = 3")).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {G2} SELECT src, count(*) AS degree, min(dst) AS least, max(dst) AS greatest FROM e GROUP BY src")
def csr_minmax(spark, sf):
    return fx.g2(spark, sf).extremes()


@query(f"WITH {G2} SELECT DISTINCT dst FROM e WHERE src = (SELECT min(src) FROM e)")
def neighbour_set(spark, sf):
    g = fx.g2(spark, sf)
    return g.edges.where(F.col("src") == _first(g)).select("dst").distinct()


@query(f"WITH {G2} SELECT src, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbours FROM e GROUP BY src")
def edge_multimap(spark, sf):
    return fx.g2(spark, sf).adjacency().select("src", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours"))


@query(f"WITH {G2}, p AS (SELECT DISTINCT a.src AS a, b.dst AS b FROM e a JOIN e b ON a.dst = b.src WHERE a.src < b.dst AND a.src % 5 = 0) SELECT p.a, p.b, x.dst AS v FROM p JOIN e x ON x.src = p.a JOIN e y ON y.src = p.b AND y.dst = x.dst")
def intersect_neighbourhood(spark, sf):
    g = fx.g2(spark, sf)
    far = g.edges.select(F.col("src").alias("m"), F.col("dst").alias("b"))
    pairs = g.edges.where("src % 5 = 0").select(F.col("src").alias("a"), F.col("dst").alias("m")).join(far, "m").where("a < b").select("a", "b").distinct()
    return g.intersect(pairs)


# --- the same reads of all vertices, pairs and edges

_ALL_PROBES = _PROBES.replace(" WHERE src % 3 = 0", "")


def _all_probes(spark, sf, g):
    return _probes(spark, sf, g).unionByName(g.edges.where("src < dst").select("src", "dst")).distinct()


@query(f"WITH {G2}, {_ALL_PROBES} SELECT pr.src, pr.dst, e.src IS NOT NULL AS present FROM pr LEFT JOIN e ON e.src = pr.src AND e.dst = pr.dst")
def has_edge_all(spark, sf):
    g = fx.g2(spark, sf)
    return g.has_edges(_all_probes(spark, sf, g))


@query(f"WITH {G2}, {_ALL_PROBES} SELECT src, dst, round(w, 6) AS weight FROM pr JOIN e USING (src, dst)")
def get_weight_all(spark, sf):
    g = fx.g2(spark, sf)
    return g.weights(_all_probes(spark, sf, g)).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {G2} SELECT src, dst FROM e")
def neighbours_of_all(spark, sf):
    g = fx.g2(spark, sf)
    return g.neighbours(g.vertices).select("src", "dst")


@query(f"WITH {G2} SELECT src, dst, round(w, 6) AS weight FROM e")
def neighbours_weighted_all(spark, sf):
    g = fx.g2(spark, sf)
    return g.neighbours(g.vertices).select("src", "dst", F.round("weight", 6).alias("weight"))


@query(f"WITH {G2}, p AS (SELECT DISTINCT a.src AS a, b.dst AS b FROM e a JOIN e b ON a.dst = b.src WHERE a.src < b.dst) SELECT p.a, p.b, x.dst AS v FROM p JOIN e x ON x.src = p.a JOIN e y ON y.src = p.b AND y.dst = x.dst")
def intersect_neighbourhood_all(spark, sf):
    g = fx.g2(spark, sf)
    far = g.edges.select(F.col("src").alias("m"), F.col("dst").alias("b"))
    pairs = g.edges.select(F.col("src").alias("a"), F.col("dst").alias("m")).join(far, "m").where("a < b").select("a", "b").distinct()
    return g.intersect(pairs)


# --- kernels: the oracle carries the full state of each round

def _spread(init: str, step: str, cap: int = 60) -> str:
    return f"t(r, v, d) AS (SELECT 0, v, {init} FROM vx UNION ALL SELECT r + 1, v, min(d) FROM (SELECT r, v, d FROM t UNION ALL SELECT t.r, e.dst, {step} FROM t JOIN e ON e.src = t.v) x WHERE r < {cap} GROUP BY r, v)"


_SOURCE = "(SELECT min(v) FROM vx)"
_HOPS = _spread(f"CASE WHEN v = {_SOURCE} THEN 0 ELSE 4294967295 END", "least(t.d + 1, 4294967295)")
_PATHS = _spread(f"CASE WHEN v = {_SOURCE} THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END", "t.d + e.w")
_LABELS = _spread("v", "t.d")


@query(f"WITH RECURSIVE {G2}, {VX}, {_HOPS} SELECT v, CAST(min(d) AS BIGINT) AS distance FROM t GROUP BY v")
def bfs(spark, sf):
    g = fx.g2(spark, sf)
    return g.bfs(_first(g))


@query(f"WITH RECURSIVE {G2}, {PARTS}, {_HOPS}, x AS (SELECT v, min(d) AS d FROM t GROUP BY v) SELECT count(*) AS traversed FROM x WHERE d <> 4294967295")
def bfs_traversed(spark, sf):
    g = fx.g2(spark, sf, all_parts=True)
    return g.bfs(_first(g)).agg(F.count_if(F.col("distance") != ids.UNREACHABLE).alias("traversed"))


@query(f"WITH RECURSIVE {G2}, {VX}, {_LABELS}, x AS (SELECT v, min(d) AS c FROM t GROUP BY v) SELECT min(v) AS source FROM x GROUP BY c HAVING count(*) > 0.75 * (SELECT count(*) FROM vx)")
def bfs_source_select(spark, sf):
    return fx.g2(spark, sf).source_candidate()


def _rank(vx: str, rounds: int, graph: str = G2) -> str:
    return f"""WITH RECURSIVE {graph}, {vx}, dg AS (SELECT v, count(e.dst) AS deg FROM vx LEFT JOIN e ON e.src = vx.v GROUP BY v), n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM vx),
t(r, v, s) AS (SELECT 0, v, 1.0 / n FROM vx, n UNION ALL
  SELECT r + 1, v, 0.15 / max(n) + 0.85 * (sum(got) + max(lost) / max(n)) FROM (
    SELECT r, v, 0.0 AS got, 0.0 AS lost FROM t WHERE r < {rounds}
    UNION ALL SELECT t.r, e.dst, t.s / dg.deg, 0.0 FROM t JOIN dg USING (v) JOIN e ON e.src = t.v WHERE t.r < {rounds}
    UNION ALL SELECT z.r, vx.v, 0.0, z.lost FROM (SELECT t.r, sum(t.s) AS lost FROM t JOIN dg USING (v) WHERE dg.deg = 0 AND t.r < {rounds} GROUP BY t.r) z, vx) x, n GROUP BY r, v)
SELECT v, round(s, 9) AS score FROM t WHERE r = {rounds}"""


def _ranked(g, rounds):
    return g.pagerank(rounds).select("v", F.round("score", 9).alias("score"))


@query(_rank(VX, 5))
def pagerank_5(spark, sf):
    return _ranked(fx.g2(spark, sf), 5)


@query(_rank(VX, 10))
def pagerank_10(spark, sf):
    return _ranked(fx.g2(spark, sf), 10)


@query(_rank(PARTS, 5))
def pagerank_dangling(spark, sf):
    return _ranked(fx.g2(spark, sf, all_parts=True), 5)


@query(f"WITH RECURSIVE {G2}, {VX}, {_PATHS} SELECT v, round(min(d), 6) AS distance FROM t GROUP BY v")
def sssp(spark, sf):
    g = fx.g2(spark, sf)
    return g.sssp(_first(g)).select("v", F.round("distance", 6).alias("distance"))


@query(f"WITH RECURSIVE {G2}, {PARTS}, {_LABELS} SELECT v, min(d) AS component FROM t GROUP BY v")
def wcc(spark, sf):
    return fx.g2(spark, sf, all_parts=True).wcc()


@query(f"WITH RECURSIVE {G2}, {VX}, {_LABELS}, x AS (SELECT v, min(d) AS component FROM t GROUP BY v) SELECT component, count(*) AS vertices FROM x GROUP BY component")
def wcc_sizes(spark, sf):
    return fx.g2(spark, sf).wcc().groupBy("component").agg(F.count("*").alias("vertices"))


@query(f"WITH {G1} SELECT count(*) AS triangles FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = a.src AND c.dst = b.dst")
def triangles(spark, sf):
    return spark.range(1).select(F.lit(triangle_count(fx.copairs(spark, sf), once=True)).cast("bigint").alias("triangles"))


def _clustering(graph: str, vx: str) -> str:
    return f"""WITH {graph}, {vx}, {_DEG}, t AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = a.src AND c.dst = b.dst),
k AS (SELECT v, count(*) AS n FROM (SELECT x AS v FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY v)
SELECT v, round(CASE WHEN degree >= 2 THEN 2.0 * coalesce(n, 0) / (degree * (degree - 1)) ELSE 0 END, 6) AS lcc FROM dg LEFT JOIN k USING (v)"""


@query(_clustering(G2, PARTS))
def lcc(spark, sf):
    return fx.g2(spark, sf, all_parts=True).lcc().select("v", F.round("lcc", 6).alias("lcc"))


@query(_clustering(G1, VX))
def lcc_dense(spark, sf):
    return clustering(None, fx.copairs(spark, sf), once=True).select("v", F.round("lcc", 6).alias("lcc"))


def _communities(vx: str, rounds: int, alone: str = "9223372036854775807") -> str:
    return f"""WITH RECURSIVE {G2}, {vx}, t(r, v, l) AS (SELECT 0, v, v FROM (SELECT DISTINCT src AS v FROM e) UNION ALL
  SELECT r, v, l FROM (SELECT t.r + 1 AS r, e.src AS v, t.l, row_number() OVER (PARTITION BY t.r, e.src ORDER BY count(*) DESC, t.l) AS k FROM t JOIN e ON e.dst = t.v WHERE t.r < {rounds} GROUP BY t.r, e.src, t.l) x WHERE k = 1)
SELECT vx.v, coalesce(t.l, {alone}) AS label FROM vx LEFT JOIN t ON t.v = vx.v AND t.r = {rounds}"""


@query(_communities(VX, 5))
def cdlp_5(spark, sf):
    return fx.g2(spark, sf).cdlp(5)


@query(_communities(VX, 30))
def cdlp_30(spark, sf):
    return fx.g2(spark, sf).cdlp(30)


@query(_communities(PARTS, 5))
def cdlp_isolated(spark, sf):
    return fx.g2(spark, sf, all_parts=True).cdlp(5)


@query(_communities(PARTS, 5, "vx.v"))
def cdlp_isolated_self(spark, sf):
    return fx.g2(spark, sf, all_parts=True).cdlp(5, isolated="self")


# --- the edge log

@query(f"WITH {LOG} SELECT version, op, src, dst, weight FROM l")
def log_normalise(spark, sf):
    return fx.log(spark, sf)


def _at(version: str) -> str:
    return f"s AS (SELECT src, dst, max_by(op, version) AS op, max_by(weight, version) AS weight FROM l WHERE version <= {version} GROUP BY src, dst)"


@query(f"WITH {LOG}, {_at('5000')} SELECT src, dst, weight FROM s WHERE op <> 'DELETE'")
def log_snapshot_v(spark, sf):
    return edge_log.snapshot(fx.log(spark, sf), 5000)


@query(f"WITH {LOG}, {_at('1000000000')} SELECT src, dst, weight FROM s WHERE op <> 'DELETE'")
def log_snapshot_final(spark, sf):
    return edge_log.snapshot(fx.log(spark, sf), 1000000000)


@query(f"WITH {LOG}, h AS (SELECT *, lead(version) OVER (PARTITION BY src, dst ORDER BY version) AS until FROM l) SELECT src, dst, version, until, weight FROM h WHERE op <> 'DELETE'")
def log_weight_history(spark, sf):
    return edge_log.weight_history(fx.log(spark, sf))


_MOVES = "m AS (SELECT src AS v, version, CASE WHEN op = 'DELETE' THEN -1 WHEN prev IN ('INSERT', 'UPSERT') THEN 0 ELSE 1 END AS c FROM l)"


@query(f"WITH {LOG}, {_MOVES} SELECT v, version, CAST(sum(c) OVER (PARTITION BY v ORDER BY version) AS BIGINT) AS degree FROM m WHERE c <> 0")
def log_degree_history(spark, sf):
    return edge_log.degree_history(fx.log(spark, sf))


@query(f"WITH {LOG}, {_at('5000')} SELECT src AS v, count(*) AS degree FROM s WHERE op <> 'DELETE' GROUP BY src")
def log_degree_at_v(spark, sf):
    return edge_log.degrees_at(fx.log(spark, sf), 5000)


@query(f"WITH {LOG} SELECT version, src, dst, weight FROM l WHERE op = 'INSERT'")
def log_insert_relaxed(spark, sf):
    return fx.log(spark, sf).where("op = 'INSERT'").drop("op")


@query(f"WITH {LOG} SELECT version, src, dst FROM l WHERE op = 'DELETE'")
def log_delete_relaxed(spark, sf):
    return fx.log(spark, sf).where("op = 'DELETE'").select("version", "src", "dst")


@query(f"WITH {RAW} SELECT version, op, src, dst, weight, CASE op WHEN 'INSERT' THEN 'EdgeExists' ELSE 'EdgeDoesNotExist' END AS why FROM prior WHERE (op = 'INSERT' AND prev IN ('INSERT', 'UPSERT')) OR (op = 'DELETE' AND (prev IS NULL OR prev = 'DELETE'))")
def log_strict_violations(spark, sf):
    return edge_log.violations(fx.raw_log(spark, sf))


_ACTIVE = [2000, 5000, 8000]
_COMPACT = f"""{LOG}, a AS (SELECT unnest([2000, 5000, 8000]) AS av), k AS (
  SELECT version FROM (SELECT version, row_number() OVER (PARTITION BY av, src, dst ORDER BY version DESC) AS r FROM l JOIN a ON version <= av) WHERE r = 1 UNION SELECT version FROM l WHERE version > 8000),
c AS (SELECT version, op, src, dst, weight, row_number() OVER (PARTITION BY src, dst ORDER BY version) AS f FROM l WHERE version IN (SELECT version FROM k))"""


@query(f"WITH {_COMPACT} SELECT version, op, src, dst, weight FROM c WHERE NOT (f = 1 AND op = 'DELETE')")
def log_compact(spark, sf):
    return edge_log.compact(fx.log(spark, sf), _ACTIVE)


@query("SELECT unnest([2000, 5000, 8000, 9000, 1000000]) AS version, CAST(0 AS BIGINT) AS differing")
def log_compact_equiv(spark, sf):
    full = cut(fx.log(spark, sf))
    small = cut(edge_log.compact(full, _ACTIVE))
    out = None
    for v in (*_ACTIVE, 9000, 1000000):
        a, b = edge_log.snapshot(full, v), edge_log.snapshot(small, v)
        one = a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.lit(v).alias("version"), F.count("*").alias("differing"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {LOG} SELECT min(least(av, m)) AS min_active, count(*) AS active FROM (SELECT unnest([2000, 5000, 8000]) AS av), (SELECT max(version) AS m FROM l)")
def log_active_min(spark, sf):
    marks = spark.createDataFrame([(v,) for v in _ACTIVE], "av bigint")
    now = fx.log(spark, sf).agg(F.max("version").alias("m"))
    return marks.join(F.broadcast(now)).agg(F.min(F.least("av", "m")).alias("min_active"), F.count("*").alias("active"))


@query(f"WITH {LOG} SELECT src, dst, count(*) AS versions, min(version) AS first_version, max(version) AS last_version FROM l GROUP BY src, dst")
def log_versions(spark, sf):
    return fx.log(spark, sf).groupBy("src", "dst").agg(F.count("*").alias("versions"), F.min("version").alias("first_version"), F.max("version").alias("last_version"))


@query(f"WITH {_ORD} SELECT src, dst FROM o WHERE i < CAST(floor(0.1 * n) AS BIGINT)")
def delete_sample(spark, sf):
    return _split(spark, sf)[2].select("src", "dst")


@query("SELECT CAST(0 AS BIGINT) AS still_visible, CAST(0 AS BIGINT) AS differing")
def delete_reinsert_equiv(spark, sf):
    """Delete a tenth of the edges, see that none is visible, insert them again, and compare with the start."""
    base = cut(fx.copart(spark, sf, 45))
    rows = lambda e, version, op: e.select(F.lit(version).cast("bigint").alias("version"), F.lit(op).alias("op"), "src", "dst", "weight")
    gone = cut(ingest.split(base, 0, 0.1, (F.col("src") * 7919 + F.col("dst") * 104729) % 1000003, "src", "dst")[2])
    log = edge_log.normalise(rows(base, 1, "INSERT").unionByName(rows(gone, 2, "DELETE")).unionByName(rows(gone, 3, "INSERT")))
    log = cut(log)
    seen = edge_log.snapshot(log, 2).join(gone.select("src", "dst"), ["src", "dst"], "left_semi").agg(F.count("*").alias("still_visible"))
    a, b = edge_log.snapshot(log, 3), base.select("src", "dst", "weight")
    return seen.join(F.broadcast(a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("differing"))))


_SNAP = f"{LOG}, {_at('5000')}, u AS (SELECT src, dst, weight AS w FROM s WHERE op <> 'DELETE'), e AS (SELECT src, dst, w FROM u UNION ALL SELECT dst, src, w FROM u)"


def _snapshot_graph(spark, sf):
    return Graph.of_edges(cut(edge_log.snapshot(fx.log(spark, sf), 5000)))


@query(f"WITH RECURSIVE {_SNAP}, {VX}, {_spread(f'CASE WHEN v = {_SOURCE} THEN 0 ELSE 4294967295 END', 'least(t.d + 1, 4294967295)', 30)} SELECT v, CAST(min(d) AS BIGINT) AS distance FROM t GROUP BY v")
def snapshot_bfs(spark, sf):
    g = _snapshot_graph(spark, sf)
    return g.bfs(_first(g))


@query(_rank(VX, 5, _SNAP))
def snapshot_pagerank(spark, sf):
    return _ranked(_snapshot_graph(spark, sf), 5)


@query(f"WITH {G2}, {PARTS}, {_DEG} SELECT v, CAST(degree AS DOUBLE) AS value, CAST(degree + CASE WHEN v % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS expected FROM dg WHERE v % 7 = 0")
def gold_compare(spark, sf):
    """Degrees against gold values that are wrong by one for each seventh vertex."""
    d = fx.g2(spark, sf, all_parts=True).degrees().select("v", F.col("degree").cast("double").alias("value"))
    return report.compare(d, d.select("v", (F.col("value") + F.when(F.col("v") % 7 == 0, 1.0).otherwise(0.00001)).alias("value"))).select("v", "value", F.round("expected", 4).alias("expected"))


# --- reports

@query(f"WITH {RUNS} SELECT experiment, ds AS graph, round(avg(runtime), 6) AS mean_runtime FROM runs WHERE repetition > 2 GROUP BY 1, 2")
def report_warm_mean(spark, sf):
    rows = report.warm(fx.runs(spark, sf)).withColumn("graph", report.dataset_name(F.col("dataset")))
    return report.mean(rows, "experiment", "graph").withColumn("mean_runtime", F.round("mean_runtime", 6))


@query(f"WITH {RUNS} SELECT experiment, count(*) AS runs FROM runs WHERE repetition = 0 GROUP BY 1")
def report_cold(spark, sf):
    return report.cold(fx.runs(spark, sf)).groupBy("experiment").agg(F.count("*").alias("runs"))


@query(f"WITH {RUNS} SELECT experiment, round(quantile_cont(runtime, 0.5), 3) AS median_runtime FROM runs GROUP BY 1")
def report_median(spark, sf):
    return report.medians(fx.runs(spark, sf), "experiment").withColumn("median_runtime", F.round("median_runtime", 3))


_PIVOT = ", ".join(f"round(avg(runtime) FILTER (ds = 'g{k}'), 6) AS g{k}" for k in range(5))


@query(f"WITH {RUNS} SELECT experiment, {_PIVOT} FROM runs GROUP BY 1")
def report_pivot(spark, sf):
    names = [f"g{k}" for k in range(5)]
    rows = fx.runs(spark, sf).withColumn("graph", report.dataset_name(F.col("dataset")))
    return report.pivot(rows, ["experiment"], "graph", names).select("experiment", *(F.round(n, 6).alias(n) for n in names))


@query(f"WITH {RUNS} SELECT experiment, round(avg(runtime) FILTER (data_structure = 's0') / avg(runtime) FILTER (data_structure = 's1'), 6) AS ratio FROM runs GROUP BY 1")
def report_ratio(spark, sf):
    return report.ratio(fx.runs(spark, sf), "experiment", "data_structure", "s0", "s1").withColumn("ratio", F.round("ratio", 6))


@query(f"WITH {RUNS}, m AS (SELECT experiment, ds AS graph, avg(runtime) AS mean_runtime FROM runs GROUP BY 1, 2) SELECT experiment, graph, round(100.0 * (mean_runtime - min(mean_runtime) OVER (PARTITION BY experiment)) / min(mean_runtime) OVER (PARTITION BY experiment), 4) AS percent FROM m")
def report_pct_diff(spark, sf):
    rows = fx.runs(spark, sf).withColumn("graph", report.dataset_name(F.col("dataset")))
    return report.percent_over_best(report.mean(rows, "experiment", "graph"), "experiment", "mean_runtime").select("experiment", "graph", F.round("percent", 4).alias("percent"))


@query(f"WITH {RUNS} SELECT execution_id, experiment, repetition, row_number() OVER (PARTITION BY execution_id, experiment ORDER BY repetition) - 1 AS n FROM runs")
def report_cumcount(spark, sf):
    return report.cumcount(fx.runs(spark, sf), ["execution_id", "experiment"], "repetition").select("execution_id", "experiment", "repetition", "n")


@query(f"WITH {RUNS} SELECT experiment, count(*) AS runs FROM (SELECT * FROM runs WHERE repetition = 0 UNION ALL SELECT * FROM runs WHERE repetition > 2) GROUP BY 1")
def report_union(spark, sf):
    rows = fx.runs(spark, sf)
    return report.cold(rows).unionByName(report.warm(rows)).groupBy("experiment").agg(F.count("*").alias("runs"))


@query(f"WITH {RUNS} SELECT execution_id, repetition, experiment, runtime FROM runs WHERE execution_id = (SELECT max(execution_id) FROM runs)")
def report_latest(spark, sf):
    return report.latest(fx.runs(spark, sf)).select("execution_id", "repetition", "experiment", "runtime")


@query(f"WITH {RUNS} SELECT experiment, min(runtime) AS least, round(quantile_cont(runtime, 0.25), 3) AS q1, round(quantile_cont(runtime, 0.5), 3) AS q2, round(quantile_cont(runtime, 0.75), 3) AS q3, max(runtime) AS greatest FROM runs GROUP BY 1")
def report_quartiles(spark, sf):
    return report.quartiles(fx.runs(spark, sf), "experiment").select("experiment", "least", *(F.round(q, 3).alias(q) for q in ("q1", "q2", "q3")), "greatest")


@query(f"WITH {RUNS} SELECT DISTINCT ds AS graph, experiment, CASE WHEN data_structure = 's0' THEN 'indirect' ELSE 'direct' END AS label FROM runs")
def report_distinct(spark, sf):
    label = F.when(F.col("data_structure") == "s0", "indirect").otherwise("direct")
    return fx.runs(spark, sf).select(report.dataset_name(F.col("dataset")).alias("graph"), "experiment", label.alias("label")).distinct()


@query(f"WITH {RUNS} SELECT experiment, round(sum(runtime) / 1000.0, 3) AS milliseconds FROM runs WHERE experiment <> 'error' AND data_structure = 's1' GROUP BY 1")
def report_filter_scale(spark, sf):
    return fx.runs(spark, sf).where("experiment <> 'error' AND data_structure = 's1'").groupBy("experiment").agg(F.round(F.sum("runtime") / 1000.0, 3).alias("milliseconds"))


@query(f"WITH {RUNS} SELECT coalesce(max(execution_id), 0) + 1 AS execution_id FROM runs")
def execution_id_next(spark, sf):
    return report.next_execution_id(fx.runs(spark, sf))

"""Command line: convert an edge list into base, insert and delete sets, or run kernels on a graph."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.cut import cut
from meshwork.graph import Graph
from meshwork.operators import ingest, report, verify
from meshwork.sources import binary, properties, specs, text
from meshwork.streaming import edges as streaming
from meshwork.txn import Store


def convert(spark: SparkSession, source: str, out: str, *, kind: str = "plain", field: int = 2, densify: bool = False, insert: float = 0.0, delete: float = 0.0, undirected: bool = False) -> None:
    """Read, clean, order and split a text edge list; write base, insertions, deletions, degrees, offsets (and the dictionary) as Parquet.

    Temporal edges are split in the order of their times, so that the last ones are inserted; others in a hashed order.
    """
    if not densify and insert < 1:
        raise ValueError("a base graph needs dense ids: give --densify")
    edges = text.read_edges(spark, source, kind, field, names=densify)
    if densify:
        names = cut(ingest.dictionary(edges))
        names.write.mode("overwrite").parquet(f"{out}/dictionary")
        edges = ingest.densify(edges, names)
    edges = cut(ingest.clean(edges, undirected=undirected))
    order = ["ts", "pos"] if kind == "temporal" else [F.xxhash64(F.lit(42), "src", "dst"), F.col("src"), F.col("dst")]
    base, inserts, deletes = ingest.split(edges, insert, delete, *order)
    both = cut(ingest.symmetric(base) if undirected else base)
    vertices = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    both.repartitionByRange("src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{out}/base")
    ingest.csr_offsets(vertices, both).write.mode("overwrite").parquet(f"{out}/offsets")
    ingest.degrees(vertices, both).write.mode("overwrite").parquet(f"{out}/degrees")
    inserts.write.mode("overwrite").parquet(f"{out}/insertions")
    deletes.write.mode("overwrite").parquet(f"{out}/deletions")


def run_kernel(graph: Graph, name: str, params: properties.AlgoParams) -> DataFrame:
    """A kernel by its name; a source that is not given is searched for."""
    if name in ("bfs", "sssp"):
        source = params.bfs_source if name == "bfs" else params.sssp_source
        if source is None:
            row = graph.source_candidate().first()
            if row is None:
                raise ValueError("no vertex reaches over three quarters of the graph")
            source = row["source"]
        return graph.bfs(source) if name == "bfs" else graph.sssp(source)
    if name == "pr":
        return graph.pagerank(params.pr_iterations, params.pr_damping)
    return {"wcc": graph.wcc, "lcc": graph.lcc, "cdlp": lambda: graph.cdlp(params.cdlp_iterations)}[name]()


def run_suite(spark: SparkSession, path: str, params: properties.AlgoParams, repetitions: int, out: str, gold: str | None = None) -> None:
    """Time kernels on Parquet edges and append the runs (microseconds) to a report. With ``gold``, results are first held against its values, or become them."""
    import time

    graph = Graph.of_edges(cut(spark.read.parquet(path)))
    try:
        past = spark.read.parquet(out)
    except Exception:  # the report's first run
        past = spark.createDataFrame([], report.SCHEMA)
    execution = report.next_execution_id(past).first()[0]
    rows = []
    for name in params.algorithms:
        if gold:
            result = run_kernel(graph, name, params)
            differ = verify.against_gold(result.toDF("v", "value"), f"{gold}/{name}")
            if differ is not None and not differ.isEmpty():
                raise ValueError(f"{name} differs from {gold}/{name}")
        for k, took in enumerate(report.timed(lambda name=name: run_kernel(graph, name, params), repetitions)):
            rows.append((execution, int(time.time()), k, path, name, "dataframe", int(took), None))
    report.append(spark.createDataFrame(rows, report.SCHEMA), out)


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="meshwork")
    sub = parser.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("input")
    c.add_argument("output")
    c.add_argument("--temporal", type=int, metavar="FIELD")
    c.add_argument("--weighted", action="store_true")
    c.add_argument("--densify", action="store_true")
    c.add_argument("--insert_percentage", type=float, default=0.0)
    c.add_argument("--delete_percentage", type=float, default=0.0)
    c.add_argument("--make_undirected", action="store_true")
    c.add_argument("--preset", choices=sorted(specs.PRESETS), help="shares of insertions and deletions")
    k = sub.add_parser("run")
    k.add_argument("edges")
    k.add_argument("report")
    k.add_argument("--properties")
    k.add_argument("--algorithms", default="bfs,pr,wcc,lcc,cdlp,sssp")
    k.add_argument("--repetitions", type=int, default=5)
    k.add_argument("--experiments", help="kernels as name(source'parameter), with commas between them")
    k.add_argument("--gold", metavar="FOLDER", help="compare results with the values there, or write them")
    g = sub.add_parser("compact")
    g.add_argument("store")
    w = sub.add_parser("insert")
    w.add_argument("edges")
    w.add_argument("store")
    w.add_argument("--weighted", action="store_true")
    w.add_argument("--undirected", action="store_true")
    w.add_argument("--batches", type=int, default=1)
    w.add_argument("--check", action="store_true")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "convert":
        kind = "temporal" if a.temporal is not None else "weighted" if a.weighted else "plain"
        insert, delete = specs.preset(a.preset) if a.preset else (a.insert_percentage, a.delete_percentage)
        convert(spark, a.input, a.output, kind=kind, field=a.temporal if a.temporal is not None else 2, densify=a.densify, insert=insert, delete=delete, undirected=a.make_undirected)
    elif a.command == "compact":
        verify.compaction(spark, Store(spark, a.store)).show(truncate=False)
    elif a.command == "insert":
        insert_stream(spark, properties.checked(a.edges, spark), a.store, weighted=a.weighted, undirected=a.undirected, batches=a.batches, check=a.check)
    else:
        params = properties.parse(spark.read.text(a.properties, wholetext=True).first()[0]) if a.properties else properties.AlgoParams(algorithms=a.algorithms.split(","))
        if a.experiments:
            params = with_specs(params, a.experiments)
        run_suite(spark, a.edges, params, a.repetitions, a.report, gold=a.gold)


def with_specs(params: properties.AlgoParams, text: str) -> properties.AlgoParams:
    """The parameters with kernels from specs: bfs(source), sssp(source), pr(iterations'damping), cdlp(iterations)."""
    names = []
    for s in specs.parse(text):
        names.append(s.name)
        if s.parameters and s.name in ("bfs", "sssp"):
            setattr(params, f"{s.name}_source", int(s.parameters[0]))
        elif s.parameters and s.name == "cdlp":
            params.cdlp_iterations = int(s.parameters[0])
        elif s.parameters and s.name == "pr":
            params.pr_iterations = int(s.parameters[0])
            params.pr_damping = float(s.parameters[1]) if len(s.parameters) > 1 else params.pr_damping
        elif s.parameters or s.name not in ("bfs", "sssp", "pr", "cdlp", "wcc", "lcc"):
            raise ValueError(f"unknown experiment {s}")
    params.algorithms = names
    return params


def insert_stream(spark: SparkSession, source: str, store: str, *, weighted: bool = False, undirected: bool = False, batches: int = 1, check: bool = False) -> list[int]:
    """Insert a binary edge list into a store: with its weights, or generated ones if it has none. ``check`` compares the store with it afterwards."""
    rows = binary.read_edge_list(spark, source, "weighted" if weighted else "plain")
    rows = cut(rows if weighted else ingest.with_weights(rows))
    where = Store(spark, store)
    versions = streaming.insert_all(where, rows, undirected=undirected, batches=batches)
    if check and any(found := verify.inserted(where.snapshot(), rows.drop("pos"), undirected=undirected).values()):
        raise ValueError(f"the store differs from {source}: {list(found)}")
    return versions


if __name__ == "__main__":
    main()

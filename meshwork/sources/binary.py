"""Binary edge lists and CSR files, little-endian.

Files that executors can open by path are read by ranges of records, many tasks for one file; those of other stores by Spark's binaryFile, a
task for each file (which must be under 2 GB there). Sinks write one file through Spark's file system, a chunk at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = {"plain": [("src", "<i8"), ("dst", "<i8")], "weighted": [("src", "<i8"), ("dst", "<i8"), ("weight", "<f8")], "temporal": [("src", "<i8"), ("dst", "<i8"), ("ts", "<i8")]}
SCHEMA = {"plain": "pos long, src long, dst long", "weighted": "pos long, src long, dst long, weight double", "temporal": "pos long, src long, dst long, ts long"}
#: Records of a range, which a task reads at once.
CHUNK = 1 << 20


def _files(spark: SparkSession, path: str) -> tuple[str, list[tuple[str, int]]]:
    """The scheme, and (path, bytes) of a file or of the files of a folder, by name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((f.getPath().toString(), f.getLen()) for f in fs.globStatus(where) or [])
    if not found:
        raise FileNotFoundError(path)
    out = []
    for name, _ in found:
        inner = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        out += [(f.getPath().toString(), f.getLen()) for f in fs.listStatus(inner) if f.isFile() and not f.getPath().getName().startswith((".", "_"))]
    return fs.getUri().getScheme(), sorted(out)


def _head(spark: SparkSession, path: str, count: int) -> tuple[int, ...]:
    """The first ``count`` unsigned 64-bit integers of a file."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
    try:
        swap = spark.sparkContext._jvm.java.lang.Long.reverseBytes
        return tuple(swap(stream.readLong()) for _ in range(count))
    finally:
        stream.close()


def _by_ranges(spark: SparkSession, ranges: list[tuple], names: str) -> DataFrame:
    rows = spark.createDataFrame(ranges, names) if ranges else spark.createDataFrame([], names)
    return rows.repartition(max(1, len(ranges)), *rows.columns)


def _at(path: str, offset: int, size: int) -> bytes:
    with open(path.removeprefix("file:"), "rb") as f:
        f.seek(offset)
        return f.read(size)


def read_edge_list(spark: SparkSession, path: str, kind: str = "plain", *, chunk: int = CHUNK) -> DataFrame:
    """(pos, src, dst[, weight | ts]) of a file ``u64 count``, then records. Of several files those of earlier names come first in pos."""
    kinds = np.dtype(RECORD[kind])
    scheme, files = _files(spark, path)
    ranges, before = [], 0
    for name, size in files:
        count = _head(spark, name, 1)[0] if size >= 8 else -1
        if size != 8 + count * kinds.itemsize:
            raise ValueError(f"{name}: {size} bytes for {count} records")
        if scheme == "file":
            ranges += [(name, before + at, 8 + at * kinds.itemsize, min(chunk, count - at)) for at in range(0, count, chunk)]
        else:
            ranges.append((name, before, 8, count))
        before += count

    def frame(raw: bytes, first: int) -> Iterator[pd.DataFrame]:
        rows = np.frombuffer(raw, kinds)
        for at in range(0, len(rows), CHUNK):
            part = rows[at : at + CHUNK]
            yield pd.DataFrame({"pos": np.arange(first + at, first + at + len(part))} | {n: part[n] for n in kinds.names})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for r in rows.itertuples(index=False):
                raw = r.content[8:] if hasattr(r, "content") else _at(r.path, r.offset, r.count * kinds.itemsize)
                yield from frame(raw, r.first)

    table = _by_ranges(spark, ranges, "path string, first long, offset long, count long")
    if scheme != "file":
        table = spark.read.format("binaryFile").load(path).select("path", "content").join(F.broadcast(table), "path")
    return table.mapInPandas(run, SCHEMA[kind])


def csr_sizes(spark: SparkSession, path: str) -> tuple[int, int]:
    """Vertices and edges of a CSR file; short and trailing data are refused."""
    _, files = _files(spark, path)
    if len(files) != 1:
        raise ValueError(f"{path}: a graph is one file")
    name, size = files[0]
    v, e = _head(spark, name, 2) if size >= 16 else (-1, -1)
    if size != 16 + 8 * (v + 1 + e):
        raise ValueError(f"{name}: {size} bytes for {v} vertices and {e} edges")
    return v, e


def csr_vertices(spark: SparkSession, path: str) -> DataFrame:
    """(v): all vertices of a CSR file, those without edges too."""
    return spark.range(csr_sizes(spark, path)[0]).select(F.col("id").alias("v"))


def read_csr(spark: SparkSession, path: str, *, chunk: int = CHUNK) -> DataFrame:
    """(src, dst) of a file ``u64 V, u64 E, u64 offsets[V + 1], u64 adjacency[E]``, by ranges of vertices.

    A vertex is read by one task, piece by piece if it has more than ``chunk`` neighbours.
    """
    v, e = csr_sizes(spark, path)
    scheme, files = _files(spark, path)
    step = max(1, min(chunk, -(-v // max(1, -(-e // chunk)))))
    ranges = [(files[0][0], at, min(step, v - at)) for at in range(0, v, step)] if scheme == "file" else [(files[0][0], 0, v)]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in frames:
            for r in rows.itertuples(index=False):
                read = (lambda offset, size, raw=r.content: raw[offset : offset + size]) if hasattr(r, "content") else lambda offset, size, path=r.path: _at(path, offset, size)
                offsets = np.frombuffer(read(16 + 8 * r.first, 8 * (r.count + 1)), "<i8")
                base = 16 + 8 * (v + 1)
                for at in range(int(offsets[0]), int(offsets[-1]), chunk):
                    end = min(at + chunk, int(offsets[-1]))
                    dst = np.frombuffer(read(base + 8 * at, 8 * (end - at)), "<i8")
                    yield pd.DataFrame({"src": r.first + np.searchsorted(offsets, np.arange(at, end), side="right") - 1, "dst": dst})

    table = _by_ranges(spark, ranges, "path string, first long, count long")
    if scheme != "file":
        table = spark.read.format("binaryFile").load(path).select("path", "content").join(F.broadcast(table), "path")
    return table.mapInPandas(run, "src long, dst long")


def _chunks(rows: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """(raw): the records of sorted rows as bytes, a row for each Arrow batch, in their order."""
    kinds = np.dtype(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, kinds)
            for k, name in enumerate(kinds.names):
                out[name] = batch.column(k).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["raw"])

    return rows.select(*kinds.names).mapInArrow(run, "raw binary")


def _write(spark: SparkSession, path: str, *parts: bytes | DataFrame) -> None:
    """Write bytes and (raw) rows, one after another; the driver holds one partition of them at a time."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, True)
    try:
        for part in parts:
            for raw in [part] if isinstance(part, bytes) else (r["raw"] for r in part.toLocalIterator()):
                stream.write(bytearray(raw))
    finally:
        stream.close()


def write_edge_list(edges: DataFrame, path: str, kind: str = "plain", *, order: str = "pos") -> int:
    """Write edges, in the order of a column, as a binary edge list; read it back and compare; returns their number."""
    from meshwork.cut import cut

    names = [n for n, _ in RECORD[kind]]
    rows = cut(edges.select(F.col(order).alias("__order"), *names).orderBy("__order", *names))
    count = rows.count()
    _write(edges.sparkSession, path, struct.pack("<Q", count), _chunks(rows, RECORD[kind]))
    back = read_edge_list(edges.sparkSession, path, kind).select(*names)
    _same(rows.select(*names), back, path)
    return count


def write_csr(vertices: DataFrame, edges: DataFrame, path: str) -> tuple[int, int]:
    """Write a graph of dense ids 0..V-1 as a binary CSR; read it back and compare; returns V and E."""
    from meshwork.cut import cut
    from meshwork.operators import ingest

    spark = edges.sparkSession
    shape = vertices.agg(F.count("v").alias("n"), F.countDistinct("v").alias("k"), F.min("v").alias("a"), F.max("v").alias("b")).first()
    if shape["n"] and (shape["a"], shape["b"], shape["k"]) != (0, shape["n"] - 1, shape["n"]):
        raise ValueError("a CSR file needs the vertices 0..V-1, each once")
    rows = cut(edges.select("src", "dst").orderBy("src", "dst"))
    e = rows.count()
    offsets = cut(ingest.csr_offsets(vertices, rows).select("v", F.col("begin").alias("x")).orderBy("v"))
    _write(spark, path, struct.pack("<QQ", shape["n"], e), _chunks(offsets, [("x", "<i8")]), struct.pack("<Q", e), _chunks(rows, [("dst", "<i8")]))
    _same(rows, read_csr(spark, path), path)
    return shape["n"], e


def _same(written: DataFrame, back: DataFrame, path: str) -> None:
    if not written.exceptAll(back).isEmpty() or not back.exceptAll(written).isEmpty():
        raise OSError(f"{path} does not read back as it was written")


def edge_list_bytes(rows: list[tuple], kind: str = "plain") -> bytes:
    """A small binary edge list (for exchange with other tools)."""
    return struct.pack("<Q", len(rows)) + np.array([tuple(r) for r in rows], np.dtype(RECORD[kind])).tobytes()


def csr_bytes(n: int, edges: list[tuple[int, int]]) -> bytes:
    """A small binary CSR of vertices 0..n-1."""
    edges = sorted(edges)
    counts = np.bincount(np.array([s for s, _ in edges], np.int64), minlength=n) if edges else np.zeros(n, np.int64)
    return struct.pack("<QQ", n, len(edges)) + np.concatenate([[0], np.cumsum(counts)]).astype("<i8").tobytes() + np.array([d for _, d in edges], "<i8").tobytes()


def read_gold(spark: SparkSession, path: str, kind: str = "bigint") -> DataFrame:
    """(v, value) of a text file of "vertex value"; integers over 4294967295 count as that."""
    rows = spark.read.text(path).where("value <> ''").select(F.split("value", " ")[0].cast("bigint").alias("v"), F.split("value", " ")[1].alias("raw"))
    value = F.col("raw").cast("double") if kind == "double" else F.least(F.try_to_number("raw", F.lit("99999999999999999999")).cast("decimal(20,0)"), F.lit(4294967295).cast("decimal(20,0)")).cast("bigint")
    return rows.select("v", value.alias("value"))

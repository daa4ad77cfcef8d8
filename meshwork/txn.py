"""A stored graph with atomic, versioned commits.

Each attempt to commit writes its Parquet data to folders of its own, ``edges/<id>`` and ``vertices/<id>``; a version is published by creating
``manifest/N``, which names all folders, whole and exclusively: of two writers of one version one fails, and takes its folders away. Readers
see whole versions only. Readers that need an old version hold a lease, a file in the store, so that compaction in any session keeps it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork import log as edge_log
from meshwork.cut import cut
from meshwork.errors import CommitConflict, EdgeDoesNotExist, EdgeExists, IllegalOperation, VertexDoesNotExist
from meshwork.graph import Graph

VERTEX_SCHEMA = "v bigint, version bigint, present boolean"
#: Seconds after which a lease that nobody has closed counts no more, and after which files that no manifest names are taken for abandoned.
LEASE_SECONDS = 86_400
ABANDONED_SECONDS = 86_400


class Store:
    """A graph under a path that driver and executors share.

    compact_after: compact and vacuum after a commit once so many folders make up the log (None: only when asked).
    """

    def __init__(self, spark: SparkSession, path: str, *, compact_after: int | None = None, lease_seconds: float = LEASE_SECONDS):
        self.spark, self.path, self.compact_after, self.lease_seconds = spark, path.rstrip("/"), compact_after, lease_seconds

    # files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, folder: str) -> list[tuple[str, float, int]]:
        """(name, seconds since the last change, bytes) of what a folder of the store holds."""
        fs, where = self._fs(f"{self.path}/{folder}")
        if not fs.exists(where):
            return []
        return [(f.getPath().getName(), time.time() - f.getModificationTime() / 1000, f.getLen()) for f in fs.listStatus(where)]

    def _delete(self, path: str) -> None:
        fs, where = self._fs(f"{self.path}/{path}")
        fs.delete(where, True)

    def _create(self, path: str, text: str) -> None:
        """Create a file whole, or raise CommitConflict if it exists."""
        fs, where = self._fs(f"{self.path}/{path}")
        fs.mkdirs(where.getParent())
        try:
            if fs.getUri().getScheme() == "file":  # there a link is what comes into being whole and once
                _, aside = self._fs(f"{self.path}/pending/{uuid.uuid4().hex}")
                self._write(fs, aside, text, True)
                files, paths = self.spark.sparkContext._jvm.java.nio.file.Files, self.spark.sparkContext._jvm.java.nio.file.Paths
                none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.java.lang.String, 0)
                try:
                    files.createLink(paths.get(where.toUri().getPath(), none), paths.get(aside.toUri().getPath(), none))
                finally:
                    fs.delete(aside, False)
            else:
                self._write(fs, where, text, False)
        except Py4JJavaError as e:
            if fs.exists(where):
                raise CommitConflict(f"{path} exists") from e
            raise

    @staticmethod
    def _write(fs, where, text: str, overwrite: bool) -> None:
        stream = fs.create(where, overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    # versions

    def versions(self) -> list[int]:
        """Published versions; a manifest that is still empty is not published yet."""
        return sorted(int(name) for name, _, size in self._names("manifest") if size and name.isdigit())

    def version(self) -> int:
        return max(self.versions(), default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"edges": [], "vertices": [], "active": []}
        fs, where = self._fs(f"{self.path}/manifest/{version}")
        stream = fs.open(where)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, version: int, manifest: dict) -> None:
        self._create(f"manifest/{version}", json.dumps(manifest))

    def _committed(self, version: int, edges: DataFrame, vertices: DataFrame, before: dict, active: list[int], streams: dict | None = None) -> int:
        """Write the data to folders of this attempt and publish them after those of ``before``; on any failure the folders go."""
        own = uuid.uuid4().hex
        try:
            edges.select("version", "seq", "op", "src", "dst", "weight").write.parquet(f"{self.path}/edges/{own}")
            vertices.select("v", F.col("version").cast("bigint").alias("version"), "present").write.parquet(f"{self.path}/vertices/{own}")
            self._publish(version, {"edges": [*before["edges"], f"edges/{own}"], "vertices": [*before["vertices"], f"vertices/{own}"], "active": active, "streams": before.get("streams", {}) | (streams or {})})
        except BaseException:
            if version not in self.versions() or f"edges/{own}" not in self._manifest(version)["edges"]:
                self._delete(f"edges/{own}")
                self._delete(f"vertices/{own}")
            raise
        return version

    # reads

    def _rows(self, kind: str, schema: str, version: int | None) -> DataFrame:
        now = self.version() if version is None else version
        paths = [f"{self.path}/{p}" for p in self._manifest(self._at(now))[kind]]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return rows.where(F.col("version") <= now)

    def log(self, version: int | None = None) -> DataFrame:
        """The normalised rows up to a version."""
        return self._rows("edges", edge_log.SCHEMA, version)

    def vertices_log(self, version: int | None = None) -> DataFrame:
        """(v, version, present): when vertices came and went, up to a version."""
        return self._rows("vertices", VERTEX_SCHEMA, version)

    def vertices(self, version: int | None = None) -> DataFrame:
        return self._present(self.vertices_log(version))

    @staticmethod
    def _present(rows: DataFrame) -> DataFrame:
        return rows.groupBy("v").agg(F.max(F.struct("version", "present")).alias("m")).where("m.present").select("v")

    def _at(self, version: int) -> int:
        """The manifest to read a version from: the newest, for compaction may have replaced older files."""
        now = self.version()
        if version > now:
            raise IllegalOperation(f"version {version} is not published")
        return now

    def snapshot(self, version: int | None = None) -> Graph:
        now = self.version() if version is None else version
        edge_log.readable(now, self._manifest(self._at(now))["active"])
        return Graph(self.vertices(now), edge_log.snapshot(self.log(now), now))

    # transactions and the versions that they hold

    def begin(self, write_only: bool = False, relaxed_vertices: bool = False, relaxed_edges: bool = False) -> Txn:
        version = self.version()
        lease = None
        if not write_only:
            lease = f"leases/{version}-{uuid.uuid4().hex}"
            self._create(lease, str(version))
        return Txn(self, version, lease, write_only, relaxed_vertices, relaxed_edges)

    def _leased(self) -> list[int]:
        return [int(name.split("-")[0]) for name, age, _ in self._names("leases") if age < self.lease_seconds and not name.startswith(".")]

    def active(self) -> list[int]:
        """Versions that open transactions of any session read, and the current one."""
        return sorted({*self._leased(), self.version()})

    def min_active(self) -> int:
        return min(self.active())

    # storage

    def compact(self, active: list[int] | None = None) -> int:
        """Rewrite the log for the active versions as a new version that reads alike; returns it. The replaced files stay until ``vacuum``."""
        now = self.version()
        active = sorted({*(self.active() if active is None else active), now})
        rows = edge_log.compact(self.log(now), active)
        kept = edge_log.slotted(self.vertices_log(now), active).groupBy("v", "__slot").agg(F.max(F.struct("version", "present")).alias("m")).select("v", "m.version", "m.present")
        before = {"edges": [], "vertices": [], "streams": self._manifest(now).get("streams", {})}
        return self._committed(now + 1, rows.repartition("src").sortWithinPartitions("src", "dst"), kept, before, active)

    def vacuum(self, abandoned_seconds: float = ABANDONED_SECONDS) -> list[str]:
        """Delete the folders that only manifests before all leases name, those that failed writers left long ago, and expired leases; returns their names.

        A plan that was made without a lease before a compaction may lose its files: hold a transaction open while it runs.
        """
        now = self.version()
        if not now:
            return []
        first = min([now, *self._leased()])
        named = {v: self._manifest(v) for v in self.versions()}
        needed = {p for v, m in named.items() if v >= first for kind in ("edges", "vertices") for p in m[kind]}
        old = {p for m in named.values() for kind in ("edges", "vertices") for p in m[kind]}
        gone = []
        for kind in ("edges", "vertices"):
            for name, age, _ in self._names(kind):
                path = f"{kind}/{name}"
                if path not in needed and (path in old or age > abandoned_seconds):
                    self._delete(path)
                    gone.append(path)
        for name, age, _ in self._names("leases"):
            if age >= self.lease_seconds:
                self._delete(f"leases/{name}")
        return gone

    def drop(self) -> None:
        """Delete the store, unless transactions read it."""
        if self._leased():
            raise IllegalOperation("open transactions read this store")
        fs, where = self._fs(self.path)
        fs.delete(where, True)

    def load(self, vertices: DataFrame, edges: DataFrame) -> int:
        """Bulk load into an empty store: edges sorted by (src, dst) at version 1, without the checks of a transaction."""
        if self.version():
            raise IllegalOperation("a bulk load needs an empty store")
        weight = F.col("weight") if "weight" in edges.columns else F.lit(None).cast("double")
        rows = edges.select(F.lit(1).cast("bigint").alias("version"), F.lit(1).alias("seq"), F.lit("INSERT").alias("op"), "src", "dst", weight.alias("weight")).repartition("src").sortWithinPartitions("src", "dst")
        return self._committed(1, rows, vertices.select("v").distinct().select("v", F.lit(1).alias("version"), F.lit(True).alias("present")), self._manifest(0), [])

    def load_csr(self, path: str, weights: Callable | None = None) -> int:
        """Bulk load of a binary CSR file; ``weights(src, dst)`` is a column expression for graphs whose file has none."""
        from meshwork.sources import binary

        edges = cut(binary.read_csr(self.spark, path))
        if weights is not None:
            edges = edges.withColumn("weight", weights(F.col("src"), F.col("dst")))
        return self.load(binary.csr_vertices(self.spark, path), edges)

    def storage(self) -> dict[str, int]:
        """Bytes of the data of the current version, and of files that ``vacuum`` may delete once no lease needs them."""
        manifest = self._manifest(self.version())
        out = {}
        for kind in ("edges", "vertices"):
            size = {}
            for name, _, _ in self._names(kind):
                fs, where = self._fs(f"{self.path}/{kind}/{name}")
                size[f"{kind}/{name}"] = fs.getContentSummary(where).getLength()
            out[kind] = sum(n for p, n in size.items() if p in manifest[kind])
            out["superseded"] = out.get("superseded", 0) + sum(n for p, n in size.items() if p not in manifest[kind])
        return out


class Txn:
    """Buffered writes and reads at one version. ``execute`` checks all of them against the newest state and publishes one version, or none.

    strict (default): edges' ends must exist or be inserted here, inserted edges must not exist, deleted ones must; the checks see this transaction's
    vertices but not its deletes of edges. relaxed_edges: inserts of present and deletes of absent edges do nothing. relaxed_vertices: missing ends
    are allowed. Inserting a vertex twice does nothing. Upserts write always, if their ends exist. Deleting a vertex deletes its edges.
    """

    def __init__(self, store: Store, read_version: int, lease: str | None, write_only: bool, relaxed_vertices: bool, relaxed_edges: bool):
        self.store, self.read_version, self.lease, self.write_only = store, read_version, lease, write_only
        self.relaxed_vertices, self.relaxed_edges = relaxed_vertices, relaxed_edges
        self._vertices: list[DataFrame] = []
        self._gone: list[DataFrame] = []
        self._edges: list[DataFrame] = []
        self._checks: list[Callable[[Graph], None]] = []
        self._stream: tuple[str, int] | None = None
        self._done = False

    def __enter__(self) -> Txn:
        return self

    def __exit__(self, *_) -> None:
        if not self._done:
            self.close()

    def _going(self) -> None:
        if self._done:
            raise IllegalOperation("the transaction has ended")

    def close(self) -> None:
        """End the transaction; a second time raises."""
        self._going()
        self._done = True
        if self.lease:
            self.store._delete(self.lease)

    def graph(self) -> Graph:
        self._going()
        if self.write_only:
            raise IllegalOperation("a write-only transaction cannot read")
        return self.store.snapshot(self.read_version)

    def insert_vertices(self, rows: DataFrame) -> Txn:
        self._going()
        self._vertices.append(rows.select("v"))
        return self

    def delete_vertices(self, rows: DataFrame) -> Txn:
        """Delete vertices and all of their edges in the newest state."""
        self._going()
        self._gone.append(rows.select("v"))
        return self

    def _buffer(self, op: str, rows: DataFrame) -> Txn:
        self._going()
        weight = F.col("weight") if "weight" in rows.columns else F.lit(None).cast("double")
        self._edges.append(rows.select(F.lit(op).alias("op"), "src", "dst", weight.alias("weight")))
        return self

    def insert_edges(self, rows: DataFrame) -> Txn:
        return self._buffer("INSERT", rows)

    def upsert_edges(self, rows: DataFrame) -> Txn:
        return self._buffer("UPSERT", rows)

    def delete_edges(self, rows: DataFrame) -> Txn:
        return self._buffer("DELETE", rows)

    def require(self, check: Callable[[Graph], None]) -> Txn:
        """A precondition: it gets the newest state and raises if it does not hold."""
        self._going()
        self._checks.append(check)
        return self

    def of_stream(self, name: str, batch: int) -> Txn:
        """This is a batch of a stream; if it, or a later one, is published already, ``execute`` does nothing and returns the current version."""
        self._going()
        self._stream = (name, batch)
        return self

    def execute(self) -> int:
        """Publish one version, or raise and leave the store as it is; the transaction ends either way."""
        self._going()
        try:
            new = self._commit()
        finally:
            self.close()
        if self.store.compact_after and len(self.store._manifest(new)["edges"]) > self.store.compact_after:
            try:
                self.store.compact()
                self.store.vacuum()
            except CommitConflict:
                pass  # another writer came first; a later commit compacts
        return new

    def _union(self, parts: list[DataFrame], schema: str) -> DataFrame:
        out = self.store.spark.createDataFrame([], schema)
        for rows in parts:
            out = out.unionByName(rows)
        return out

    def _commit(self) -> int:
        store = self.store
        now = store.version()
        new, manifest = now + 1, store._manifest(now)
        if self._stream and manifest.get("streams", {}).get(self._stream[0], -1) >= self._stream[1]:
            return now
        if self._checks:
            state = store.snapshot(now)
            for check in self._checks:
                check(state)
        log, vertex_log = store.log(now), store.vertices_log(now)
        edges = cut(self._union(self._edges, "op string, src bigint, dst bigint, weight double"))
        inserted, gone = cut(self._union(self._vertices, "v bigint").distinct()), cut(self._union(self._gone, "v bigint").distinct())
        if not inserted.join(gone, "v", "left_semi").isEmpty():
            raise IllegalOperation("a vertex is both inserted and deleted")
        # the stored rows of what the transaction touches, and no others
        ends = edges.where("op <> 'DELETE'").select(F.explode(F.array("src", "dst")).alias("v"))
        known = cut(store._present(vertex_log.join(ends.unionByName(inserted).unionByName(gone).distinct(), "v", "left_semi")))
        if not self.relaxed_vertices:
            if bad := gone.join(known, "v", "left_anti").take(1):
                raise VertexDoesNotExist(f"vertex {bad[0]['v']}")
            if bad := ends.distinct().join(known.join(gone, "v", "left_anti").unionByName(inserted), "v", "left_anti").take(1):
                raise VertexDoesNotExist(f"vertex {bad[0]['v']}")
        own = log.join(edges.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
        if self._gone:
            at = lambda side: log.join(gone.withColumnRenamed("v", side), side, "left_semi").select(*log.columns)
            own = own.select(*log.columns).unionByName(at("src")).unionByName(at("dst"))
        present = cut(edge_log.snapshot(own, now).select("src", "dst"))
        if not self.relaxed_edges:
            inserts = edges.where("op = 'INSERT'")
            if bad := inserts.join(present, ["src", "dst"], "left_semi").take(1) or inserts.groupBy("src", "dst").count().where("count > 1").take(1):
                raise EdgeExists(f"edge ({bad[0]['src']}, {bad[0]['dst']})")
            if bad := edges.where("op = 'DELETE'").join(present, ["src", "dst"], "left_anti").take(1):
                raise EdgeDoesNotExist(f"edge ({bad[0]['src']}, {bad[0]['dst']})")
        if self._gone:
            lost = present.join(gone.withColumnRenamed("v", "src"), "src", "left_semi").unionByName(present.join(gone.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst"))
            edges = edges.unionByName(lost.select(F.lit("DELETE").alias("op"), "src", "dst", F.lit(None).cast("double").alias("weight")))
        once = edges.groupBy("op", "src", "dst").agg(F.min("weight").alias("weight"))  # a repeated row of a relaxed transaction counts once
        before = present.select(F.lit(now).cast("bigint").alias("version"), F.lit("INSERT").alias("op"), "src", "dst", F.lit(None).cast("double").alias("weight"))
        rows = edge_log.normalise(before.unionByName(once.select(F.lit(new).cast("bigint").alias("version"), "op", "src", "dst", "weight"))).where(F.col("version") == new)
        vertices = inserted.join(known, "v", "left_anti").select("v", F.lit(True).alias("present")).unionByName(gone.join(known, "v", "left_semi").select("v", F.lit(False).alias("present")))
        return store._committed(new, rows.withColumn("seq", edge_log.seq_of(F.col("op"))), vertices.withColumn("version", F.lit(new)), manifest, manifest["active"], dict([self._stream]) if self._stream else None)

"""Property files of benchmark graphs."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import PurePosixPath

from pyspark.sql import SparkSession

#: Experiments of each algorithm name.
EXPERIMENTS = {"bfs": ["bfs", "bsbfs"], "pr": ["pr", "bspr"], "cdlp": ["cdlp"], "lcc": ["lcc"], "sssp": ["sssp"], "wcc": ["wcc"]}


@dataclass
class AlgoParams:
    """What a property file says of a graph and of its algorithms; None where it says nothing."""

    vertices: int | None = None
    edges: int | None = None
    weighted: bool = False
    bfs_source: int | None = None
    sssp_source: int | None = None
    cdlp_iterations: int = 30
    pr_damping: float = 0.85
    pr_iterations: int = 5
    algorithms: list[str] = field(default_factory=list)

    def experiments(self) -> list[str]:
        return [x for a in self.algorithms for x in EXPERIMENTS[a]]


def parse(text: str) -> AlgoParams:
    """``key = value`` lines, ``#`` comments; keys are told by their last dotted parts. Directed graphs and weights of another kind are refused."""
    out = AlgoParams()
    for raw in text.splitlines():
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        key, eq, value = line.partition("=")
        if not eq:
            raise ValueError(f"no '=' in: {line}")
        parts, value = key.strip().split("."), value.strip()
        last, two = parts[-1], ".".join(parts[-2:])
        if last == "algorithms":
            out.algorithms = [a.strip().lower() for a in value.split(",") if a.strip()]
            if unknown := [a for a in out.algorithms if a not in EXPERIMENTS]:
                raise ValueError(f"unknown algorithms: {unknown}")
        elif last == "vertices":
            out.vertices = int(value)
        elif last == "edges":
            out.edges = int(value)
        elif last == "directed" and value.lower() == "true":
            raise ValueError("directed graphs are not supported")
        elif two == "edge-properties.names":
            if value != "weight":
                raise ValueError(f"unknown edge property: {value}")
            out.weighted = True
        elif two == "edge-properties.types" and value != "real":
            raise ValueError(f"unknown type of weight: {value}")
        elif two == "bfs.source-vertex":
            out.bfs_source = int(value)
        elif two == "sssp.source-vertex":
            out.sssp_source = int(value)
        elif two == "cdlp.max-iterations":
            out.cdlp_iterations = int(value)
        elif two == "pr.damping-factor":
            out.pr_damping = float(value)
        elif two == "pr.num-iterations":
            out.pr_iterations = int(value)
    return out


@dataclass(frozen=True)
class Dataset:
    """Where the files of a graph are; a name ending in -u is of an undirected graph."""

    directory: str

    @property
    def name(self) -> str:
        return PurePosixPath(self.directory).name

    @property
    def undirected(self) -> bool:
        return self.name.endswith("-u")

    def base(self) -> str:
        return f"{self.directory}/base.csr"

    def insertions(self) -> str:
        return f"{self.directory}/insertions.edgeList"

    def gold(self, algorithm: str) -> str:
        return f"{self.directory}/{algorithm}.gold_standard"


def checked(path: str, spark: SparkSession | None = None) -> str:
    """A path whose suffix names a known format, and, where a session is given, at which there is a file."""
    if PurePosixPath(path).suffix not in (".csr", ".edgeList", ".parquet"):
        raise ValueError(f"unknown kind of file: {path}")
    if spark is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            raise FileNotFoundError(path)
    return path

"""What a graph store refuses."""


class GraphError(Exception):
    pass


class IllegalOperation(GraphError):
    """A read on a write-only transaction, or a use after its end."""


class VertexDoesNotExist(GraphError):
    pass


class EdgeExists(GraphError):
    pass


class EdgeDoesNotExist(GraphError):
    pass


class NoProperties(GraphError):
    """Weights were asked of an unweighted graph."""


class SnapshotGone(GraphError):
    """A version that compaction has merged away."""


class CommitConflict(GraphError):
    """Another writer published the version first."""

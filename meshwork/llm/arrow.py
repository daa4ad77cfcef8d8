"""Running a Python function over the texts of a DataFrame in bounded Arrow shards, without a shuffle."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import filterfalse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_BYTES = 4 << 20
SHARD_ROWS = 4096

#: A-Z to a-z; digits, a-z and all bytes over 0x7F stay; every other byte is a space.
FOLD = bytes((i | 32) if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def unknown(sets: list, known: dict) -> list:
    """The distinct items of collections that are no keys of ``known``."""
    return list(filterfalse(known.__contains__, set().union(*sets)))


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text."""
    return text.translate(FOLD).split()


def free(name: str, columns: list[str]) -> str:
    """The name, with underscores after it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(columns: list[str], names: list[str]) -> list[str]:
    """The columns but those that new ones of these names take the place of; Spark's names differ by more than case."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def shards(batch: pa.RecordBatch, column: int, limit: int, rows: int = SHARD_ROWS) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of a batch with at most ``rows`` rows and ``limit`` bytes of text, or a single row; a null text is None."""
    texts = batch.column(column).cast(pa.large_binary())
    start, held = 0, 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        if i > start and (held + (n or 0) > limit or i - start >= rows):
            yield batch.slice(start, i - start), texts.slice(start, i - start).to_pylist()
            start, held = i, 0
        held += n or 0
    if start < batch.num_rows:
        yield batch.slice(start), texts.slice(start).to_pylist()


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive tasks, and two of them share an executor with its JVM."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def add_columns(
    docs: DataFrame, fields: str, make: Callable[[], Callable[..., list]], *, text_col: str = "text", also: list[str] | None = None, keep: list[str] | None = None, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """``docs`` with further columns made from its text, a row for each row.

    make: called once in each task; what it returns gets the UTF-8 texts of a shard, and the shard's values of each column of ``also``, and returns a
    list of values for each field.
    keep: the columns that stay (default: all). Of those, any with the name of a new field, in whatever case, give way to it.
    """
    added = T.StructType.fromDDL(fields)
    kept = without(docs.columns if keep is None else keep, added.names)
    also = also or []
    text = free("__text", kept)
    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{text_col}`").alias(text), *(F.col(f"`{c}`").alias(f"{text}{i}") for i, c in enumerate(also)))
    schema = T.StructType([*rows.schema.fields[: len(kept)], *added.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [f.type for f in to_arrow_schema(added)]
    names = [*kept, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part, texts in shards(batch, len(kept), shard_bytes, shard_rows):
                made = [pa.array(v, type=t) for v, t in zip(work(texts, *(c.to_pylist() for c in part.columns[len(kept) + 1 :])), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], names=names)
        del work
        give_back()

    return rows.mapInArrow(run, schema)

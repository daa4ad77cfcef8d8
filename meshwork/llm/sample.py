"""Bounded samples of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of a training sample: documents for each class, and bytes of a document (of longer ones evenly dealt stretches are learned from).
PER_CLASS = 2000
MOST_BYTES = 1 << 16
STRETCHES = 8


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds))


def stretches(text: Column, most_bytes: int = MOST_BYTES, count: int = STRETCHES) -> Column:
    """The text, or of one over ``most_bytes`` stretches from its beginning to its end that come to less."""
    size = most_bytes // (4 * count) - 1  # code points of at most four bytes
    parts = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.substr(text, (F.floor(i * (F.length(text) - size) / (count - 1)) + 1).cast("int"), F.lit(size)))
    return F.when(F.octet_length(text) > most_bytes, F.array_join(parts, " ")).otherwise(text)


def labelled(
    docs: DataFrame, labels: DataFrame, label: str, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, per_class: int = PER_CLASS, most_bytes: int = MOST_BYTES
) -> DataFrame:
    """(id, text, y): at most ``per_class`` documents of either label 0 and 1, those of the smallest hashed ids, and any repeated rows of these.

    held_out: a condition on ``labels``; its rows are never read for learning. Ids with contradicting labels count as 1. Ids are chosen
    from the labels alone and joined as a broadcast of at most 2 * per_class rows.
    """
    rows = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull())
    if held_out is not None:
        rows = rows.where(~held_out)
    rows = rows.groupBy(F.col(id_col).alias("id")).agg(F.max(label).alias("y"))
    chosen = [rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return texts.join(F.broadcast(chosen[0].unionByName(chosen[1])), "id").withColumn("text", stretches(F.col("text"), most_bytes))


def collected(rows: DataFrame, per_class: int) -> tuple[list[bytes], list[int]]:
    """The sample's texts and labels on the driver, in the order of their ids; repeated rows of an id beyond the bound are left out."""
    got = rows.select("id", F.coalesce("text", F.lit("")).cast("binary").alias("text"), "y").orderBy("id", "text").limit(4 * per_class).collect()
    return [bytes(r["text"]) for r in got], [int(r["y"]) for r in got]

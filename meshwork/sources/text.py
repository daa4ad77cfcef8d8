"""Text edge lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators in the order they are tried, and what begins a comment.
SEPARATORS = [",", " ", "\t"]
COMMENT = "^[#%]"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the lines of text files, numbered in their order."""
    from meshwork.functions.ids import number_rows

    rows = spark.read.text(path).select("value", F.input_file_name().alias("__file"), F.monotonically_increasing_id().alias("__row"))
    return number_rows(rows, "__file", "__row", name="pos").select("pos", "value")


def without_comments(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("value").rlike(COMMENT))


def separator(rows: DataFrame) -> str:
    """The first of comma, space and tab that the first line other than a comment holds."""
    first = without_comments(rows).orderBy("pos").select("value").first()
    found = next((s for s in SEPARATORS if first is not None and s in first["value"]), None)
    if found is None:
        raise ValueError("no separator in the first line that is no comment")
    return found


def parse(rows: DataFrame, sep: str, kind: str = "plain", field: int = 2, names: bool = False) -> DataFrame:
    """(pos, src, dst[, weight | ts]) from lines (pos, value); ``field`` is where the weight or the time (seconds) stands.

    names: src and dst stay strings, to be densified.
    """
    parts = F.split("value", {"\t": "\t", " ": " ", ",": ","}.get(sep, sep), -1)
    id_of = (lambda i: parts[i]) if names else (lambda i: parts[i].cast("bigint"))
    out = [F.col("pos"), id_of(0).alias("src"), id_of(1).alias("dst")]
    if kind == "weighted":
        out.append(parts[field].cast("double").alias("weight"))
    elif kind == "temporal":
        out.append(parts[field].cast("bigint").alias("ts"))
    elif kind != "plain":
        raise ValueError(f"unknown kind of edge list: {kind}")
    return without_comments(rows).select(*out)


def read_edges(spark: SparkSession, path: str, kind: str = "plain", field: int = 2, names: bool = False) -> DataFrame:
    rows = lines(spark, path)
    return parse(rows, separator(rows), kind, field, names)

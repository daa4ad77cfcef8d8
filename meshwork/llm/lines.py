"""Line dedup by site-relative frequency, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.cut import cut
from meshwork.llm.arrow import free, without

MAX_RATIO = 0.01
#: A line on a single page of its host repeats nothing, whatever its share of a small host.
MIN_PAGES = 2
#: Boilerplate lines of up to so many bytes are broadcast (LINE_BYTES each and their host's name); more are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
LINE_BYTES = 40
#: Copies of a host's boilerplate lines in that shuffle, so that a host with a third of all rows is dealt over them.
SALTS = 32


def _key(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(7), line).alias("g"))


def boilerplate(docs: DataFrame, *, text_col: str, host_col: str, max_ratio: float, min_pages: int) -> DataFrame:
    """host, h, g, pages, total: the keys of lines that over ``max_ratio`` of their host's pages hold, and at least ``min_pages``."""
    pages = docs.select(F.col(f"`{host_col}`").alias("host"), F.array_distinct(F.filter(F.split(F.col(f"`{text_col}`"), "\n", -1), lambda x: x.rlike("[^ \\t\\r]"))).alias("lines"))
    totals = pages.groupBy("host").agg(F.count("*").alias("total"))
    counts = pages.select("host", F.explode("lines").alias("line")).select("host", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g")).groupBy("host", "h", "g").agg(F.count("*").alias("pages"))
    return counts.where(F.col("pages") >= min_pages).join(totals, "host").where(F.col("pages") / F.col("total") > max_ratio)


def drop_boilerplate(docs: DataFrame, *, text_col: str = "text", host_col: str = "source", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Drop from each text the lines that repeat on more than ``max_ratio`` of the pages of its host.

    Returns all rows and columns with the text rewritten, and n_lines and n_dropped. A page counts a line once however often it
    holds it, and loses all of its occurrences. Lines are counted by 128-bit keys, summed before the shuffle, so a host or a line
    with a third of all rows is a few rows of each task. A host has at most (lines of a page / max_ratio) boilerplate lines.

    Null text stays null (n_lines 0). Rows with a null host stay as they are. Lines of blanks alone are never dropped, nor lines on less than
    ``min_pages`` pages. Repeated rows count as pages each. Empty table: no rows. A text may become empty; its row stays. Columns named n_lines or n_dropped give way.
    """
    kept = without(docs.columns, ["n_lines", "n_dropped"])
    host, hidden, split, hit, left, salt = (free(n, kept) for n in ("__host", "__bad", "__lines", "__hit", "__left", "__salt"))
    found = cut(boilerplate(docs, text_col=text_col, host_col=host_col, max_ratio=max_ratio, min_pages=min_pages))
    small = (found.agg(F.sum(F.octet_length(F.col("host").cast("string")) + LINE_BYTES)).first()[0] or 0) <= broadcast_bytes
    bad = found.groupBy(F.col("host").alias(host)).agg(F.collect_list(F.struct("h", "g")).alias(hidden))
    rows = docs.select(*(F.col(f"`{c}`") for c in kept))
    text = F.col(f"`{text_col}`")
    if small:
        rows = rows.join(F.broadcast(bad), F.col(f"`{host_col}`") == F.col(host), "left")
    else:
        bad = bad.withColumn(salt + "r", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")).join(bad, (F.col(f"`{host_col}`") == F.col(host)) & (F.col(salt) == F.col(salt + "r")), "left")
    lines = F.split(text, "\n", -1)
    # a hashed intersection finds the few of the host's lines that the page may hold; these are compared in full
    rows = rows.withColumn(split, lines).withColumn(hit, F.array_intersect(F.transform(split, lambda x: F.xxhash64(x)), F.transform(hidden, lambda b: b["h"])))
    rows = rows.withColumn(hidden, F.filter(hidden, lambda b: F.array_contains(F.col(hit), b["h"])))
    rows = rows.withColumn(left, F.when(F.coalesce(F.size(hit), F.lit(0)) <= 0, F.col(split)).otherwise(F.filter(split, lambda x: ~x.rlike("[^ \\t\\r]") | ~F.array_contains(F.col(hidden), _key(x)))))
    count = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.size(c)), F.lit(0)).cast("long")
    return rows.select(
        *((F.when(F.size(left) < F.size(split), F.array_join(left, "\n")).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`")) for c in kept), count(split).alias("n_lines"), (count(split) - count(left)).alias("n_dropped")
    )

"""From raw documents to packed training sequences; each stage calls one operator.

Stages hand on the columns of documents as they are: what an operator adds never takes the place of a column of the caller's, whatever its
name. A stage over an empty table returns an empty table. Only toxicity and near-dedup drop rows; text and n_chars change where a
stage removes something.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.cut import cut
from meshwork.llm import decontam, lines, neardup, packing, toxicity

#: Lines that repeat on more of their source's pages go. On the test tables no line of over 50 words comes to 1 % (0.8 % at most), so copied passages stay for near-dedup.
LINE_RATIO = 0.01
#: Lines on fewer pages stay here: in a small source they may be a few copies of one text, of which near-dedup keeps one.
LINE_PAGES = 5


def _apart(docs: DataFrame, *needed: str) -> DataFrame:
    """own, a struct of all columns of ``docs``, beside the columns that an operator reads."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), *(F.col(f"`{c}`") for c in needed))


def _rewritten(rows: DataFrame, docs: DataFrame, text: Column, changed: Column) -> DataFrame:
    """The columns of ``docs`` out of own, with another text, and its length in n_chars (if there is one) where it changed."""
    put = {"text": F.when(changed, text).otherwise(F.col("own.text")), "n_chars": F.when(changed, F.length(text).cast("long")).otherwise(F.col("own.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return rows.select(*((put[c] if c in put else F.col(f"own.`{c}`")).alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier, trained on the labels, does not reject.

    Null and empty texts have the classifier's bias alone and stay; repeated rows are judged each, alike; without labels (empty table, or of one
    class) all stay. Whole texts are read, however long.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.learn_toxicity(docs, labels)
    return toxicity.score(_apart(docs, "text"), model, keep=["own"]).where("predicted = 0").select("own.*")


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate of their source.

    A line goes from all pages of the source; a line on under LINE_PAGES of them never goes. Null texts stay null, rows with a null source stay as they are, a text may
    become empty. Repeated rows count as pages each.
    """
    rows = lines.drop_boilerplate(_apart(docs, "text", "source"), max_ratio=LINE_RATIO, min_pages=LINE_PAGES)
    return _rewritten(rows, docs, F.col("text"), F.col("n_dropped") > 0)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, that of the least id (null ids last).

    Rows without words (null, empty) all stay. Rows repeated with id and text are copies: one stays.
    """
    return neardup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of test items: these are cut out and a space put there.

    Null texts stay null; with an empty benchmark, or items without words, nothing changes.
    """
    found = decontam.decontaminate(_apart(docs, "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["own"], clean=True)
    return _rewritten(found, docs, F.col("clean_text"), F.col("n_hit") > 0)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences: a row for each piece of a document.

    Null and empty texts are the end id alone; repeated rows are packed each.
    """
    return packing.pack(docs, keep=["doc_id"], remember=300_000, between_tasks=False, shard_bytes=4 << 20)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_copies), ("decontamination", drop_benchmark), ("packing", pack_sequences)]

#: The classifier's training and the tokenizer can't be said in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs

"""Queries that apply each operator, with production parameters, to its whole table; SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.llm import decontam, html, langid, lines, neardup, packing, quality, rules, toxicity, urls
from meshwork.llm.sample import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.size("spans").cast("long").alias("n_spans")
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    model = quality.learn_quality(docs, table(spark, sf_dir, "labels"), held_out=held)
    return quality.score(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = rules.learn_rules(docs, table(spark, sf_dir, "labels"), held_out=fold(F.col("doc_id"), 3) == 1)
    return rules.judge(docs, learned, keep=["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rules_frame(spark), keep=["page_id"])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn_languages(docs, held_out=fold(F.col("id"), 4) == 2)
    return langid.identify(docs, model, keep=["doc_id"]).select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    model = toxicity.learn_toxicity(docs, table(spark, sf_dir, "labels"), held_out=held)
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep=["doc_id"])


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_quality_classifier, op3_quality_rules, op4_minhash_dedup, op5_url_filter, op6_line_dedup, op7_language_id, op8_html_text, op9_toxicity, op10_pack)}

ORACLE = {
    "op5_url_filter": """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (SELECT page_id, host, path, rh, rp, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rh || rp AS rule, coalesce(rv, 'allow') AS verdict FROM m WHERE k = 1""",
    "op6_line_dedup": """
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT source, line FROM l JOIN t USING (source) WHERE regexp_matches(line, '[^ \\t\\r]') GROUP BY source, line, total HAVING count(DISTINCT doc_id) >= 2 AND count(DISTINCT doc_id) / total > 0.01),
k AS (SELECT l.doc_id, l.line, l.pos, b.line IS NULL AS stays FROM l LEFT JOIN b ON l.source = b.source AND l.line = b.line)
SELECT d.doc_id, coalesce(x.n_lines, 0) AS n_lines, coalesce(x.n_dropped, 0) AS n_dropped, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(x.text, '') END AS text
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped, string_agg(line, chr(10) ORDER BY pos) FILTER (stays) AS text FROM k GROUP BY doc_id) x USING (doc_id)""",
}

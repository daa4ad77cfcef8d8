"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.cut import cut
from meshwork.llm.arrow import without

#: Hex digits of the digest that the join is on (32 bits).
SHORT = 8
#: Rules of up to so many bytes are broadcast (twice their text and RULE_BYTES each).
BROADCAST_BYTES = 16 << 20
RULE_BYTES = 200
#: Copies of each rule, and salts of the urls, when rules are joined by a shuffle: a host with a third of all rows is dealt over them.
SALTS = 32

#: The rules of the contract, (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` (A-Z lower-cased), and then up to ``?``, ``#``; else empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, *, url_col: str = "url", keep: list[str] | None = None, default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES, salts: int = SALTS) -> DataFrame:
    """Judge urls by rules (host, path, verdict): a rule fits its host and all its subdomains where the path starts with the rule's.

    Each url is expanded into its host suffixes (of the numbers of labels that rules have) by its path prefixes (of the lengths that rules have); the expressions' SHA-256 meet
    the rules' on their first digits, then on the whole digest. Of the fitting rules the longest (host and path) wins, then the
    longer host, then block over allow. Returns the kept columns (default: all), host, path, rule (null if none fits) and verdict
    (``default`` if none).

    Null url or one without ``://``: empty host and path, no rule. Repeated rows are judged each; repeated rules count once. Rules
    with a null are ignored; no rules: all get the default. Columns named like a new one give way to it.
    """
    kept = without(pages.columns if keep is None else keep, ["host", "path", "rule", "verdict"])
    good = rules.where("host IS NOT NULL AND path IS NOT NULL AND verdict IS NOT NULL").select(F.concat("host", "path").alias("r"), F.length("host").alias("hl"), F.size(F.split("host", "\\.", -1)).alias("labels"), "path", "verdict").distinct()
    counts = sorted(r[0] for r in good.select("labels").distinct().collect())  # distinct numbers of labels of rules' hosts, and below
    lengths = sorted(r[0] for r in good.select(F.length("path")).distinct().collect())  # distinct lengths of rules' paths: bounded by the longest url
    good = good.select(F.substring(F.sha2("r", 256), 1, SHORT).alias("rshort"), F.sha2("r", 256).alias("rdigest"), F.struct(F.length("r").alias("n"), "hl", F.when(F.col("verdict") == "block", 1).otherwise(0).alias("b"), "r", "verdict").alias("hit"))
    small = (good.agg(F.sum(2 * F.octet_length("hit.r") + RULE_BYTES)).first()[0] or 0) <= broadcast_bytes

    host, path = host_and_path(F.col(f"`{url_col}`"))
    rows = pages.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("own"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("rid"))
    if not small:
        rows = cut(rows)  # row ids must not change between two shuffles
    labels = F.split("host", "\\.", -1)
    suffixes = F.filter(F.array(*(F.when(F.size(labels) >= k, F.array_join(F.slice(labels, F.size(labels) - (k - 1), F.lit(k)), ".")) for k in counts)), lambda s: s.isNotNull()) if counts else F.array().cast("array<string>")
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    exprs = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))
    wide = rows.withColumn("e", F.explode_outer(exprs)).withColumn("digest", F.sha2("e", 256)).withColumn("short", F.substring("digest", 1, SHORT)).drop("e")
    if small:
        met = wide.join(F.broadcast(good), F.col("short") == F.col("rshort"), "left")
    else:
        dealt = good.withColumn("rsalt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = wide.withColumn("salt", F.pmod(F.col("rid"), F.lit(salts)).cast("int")).join(dealt, (F.col("short") == F.col("rshort")) & (F.col("salt") == F.col("rsalt")), "left")
    best = met.groupBy("rid").agg(F.first("own").alias("own"), F.first("host").alias("host"), F.first("path").alias("path"), F.max(F.when(F.col("digest") == F.col("rdigest"), F.col("hit"))).alias("hit"))
    return best.select("own.*", "host", "path", F.col("hit.r").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))

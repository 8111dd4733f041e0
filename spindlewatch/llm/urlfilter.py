"""URL rules by hashed host-suffix and path-prefix expressions.

A URL is expanded into its host suffixes times its path prefixes. Every expression is hashed; the first four bytes are joined with those
of the rules, the full digests confirm a match, and the longest confirmed rule decides. Only suffixes with as many labels and prefixes
with as many characters as some rule has are made, so the expansion has a bound and is still exact for rules that end inside a path
segment.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindlewatch.llm.common import UPPER

PREFIX_HEX = 8
BROADCAST_RULES = 50_000
SALTS = 32


def parts(url: str | Column) -> tuple[Column, Column]:
    """Host (after the first :// up to / ? # or end, A-Z lower-cased) and path (up to ? # or end); both empty without ://."""
    url = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    has = F.instr(url, "://") > 0
    rest = F.when(has, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)\A[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"(?s)\A[^?#]*", 0)
    return F.translate(host, UPPER, UPPER.lower()), path


def expression(host: Column, path: Column) -> Column:
    """What is hashed; the separator can't occur in a host."""
    return F.sha2(F.concat(host, F.lit("#"), path).cast("binary"), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per row of pages (page_id, url): page_id, host, path, rule, verdict.

    rules has host, path, verdict. A rule fits its host and all subdomains if the path starts with the rule's; the longest host and path
    wins, then the longer host. default is the verdict where no rule fits. Repeated rows are judged once and returned as often as they
    came; a null page_id or url is kept. An empty table gives no rows, no rules give the default.
    """
    spark = pages.sparkSession
    ruled = rules.select(F.col("host").alias("_rh"), F.col("path").alias("_rp"), F.col("verdict").alias("_rv")).dropDuplicates(["_rh", "_rp"])
    shape = ruled.agg(F.collect_set(F.size(F.split("_rh", r"\."))).alias("labels"), F.collect_set(F.length("_rp")).alias("chars"), F.count("*").alias("n")).first()
    host, path = parts("url")
    own = pages.groupBy("page_id", "url").agg(F.count("*").alias("_copies")).select("page_id", "url", "_copies", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.")
    suffixes = F.filter(F.lit(sorted(shape["labels"])), lambda n: n <= F.size(labels)) if shape["labels"] else F.array().cast("array<int>")
    suffixes = F.transform(suffixes, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))
    prefixes = F.filter(F.lit(sorted(shape["chars"])), lambda n: n <= F.length("path")) if shape["chars"] else F.array().cast("array<int>")
    prefixes = F.transform(prefixes, lambda n: F.substr(F.col("path"), F.lit(1), n))
    wanted = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: expression(h, p))))
    digests = ruled.withColumn("_rd", expression(F.col("_rh"), F.col("_rp")))
    key = F.substring("_d", 1, PREFIX_HEX)
    expanded = own.select("*", F.explode_outer(wanted).alias("_d")).withColumn("_key", key)
    keyed = digests.withColumn("_key", F.substring("_rd", 1, PREFIX_HEX))
    if shape["n"] <= BROADCAST_RULES:
        met = expanded.join(F.broadcast(keyed), "_key", "left")
    else:  # an expression that many URLs share is spread over copies of the rules
        salted = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expanded.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["_key", "_salt"], "left")
    fits = F.when(F.col("_d") == F.col("_rd"), F.struct((F.length("_rh") + F.length("_rp")).alias("size"), F.length("_rh").alias("host_size"), F.concat("_rh", "_rp").alias("rule"), F.col("_rv").alias("verdict")))
    best = met.groupBy("page_id", "url", "host", "path", "_copies").agg(F.max(fits).alias("_best"))
    copies = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy")
    verdict = F.coalesce("_best.verdict", F.lit(default))
    return best.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"), copies).drop("_copy")

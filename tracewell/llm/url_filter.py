"""URL rules by expression hashing: host suffixes x path prefixes, short-hash equi-join, digest check.

The rules' own label counts and path lengths say which suffixes and prefixes
of a url can match at all, so an url expands into (label counts) x (path
lengths) expressions and no more, however long it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import ascii_lower

#: Fixed values of the contract: (action, host, path).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

RULE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("action", "host", "path")])


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    short_hex: int = 8,
) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict.

    A rule fits its host and all subdomains when the url's path starts with its
    path; the longest fitting rule wins, host labels before path length, then
    block before allow.  Null urls and urls without ``://`` have empty host and
    path and fit no rule.  Pages are judged once per distinct (host, path), so a
    host with a third of all pages is pre-aggregated.  Repeated rows stay.
    """
    spark = pages.sparkSession
    base = (
        pages.select(F.col(id_col).alias("_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"))
        .select("_id", url_host(F.col("_url")).alias("_host"), url_path(F.col("_url")).alias("_path"))
    )
    if not rules:
        return base.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = sorted({len(h.split(".")) for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    digest = F.sha2(F.concat_ws("\n", "_h", "_p"), 256)

    parts = F.split("_host", r"\.")
    urls = base.select("_host", "_path").distinct()
    expressions = (
        urls.withColumn("_parts", parts)
        .withColumn("_k", F.explode(F.array(*map(F.lit, labels))))
        .where(F.size("_parts") >= F.col("_k"))
        .withColumn("_h", F.array_join(F.slice("_parts", F.size("_parts") - F.col("_k") + 1, F.col("_k")), "."))
        .withColumn("_l", F.explode(F.array(*map(F.lit, lengths))))
        .where(F.length("_path") >= F.col("_l"))
        .withColumn("_p", F.substring(F.col("_path"), F.lit(1), F.col("_l")))
        .withColumn("_digest", digest)
        .select("_host", "_path", "_digest", F.substring("_digest", 1, short_hex).alias("_short"))
    )
    known = (
        spark.createDataFrame([tuple(r) for r in rules], RULE_SCHEMA)
        .select("action", F.col("host").alias("_h"), F.col("path").alias("_p"))
        .withColumn("_rank", F.size(F.split("_h", r"\.")) * 1_000_000 + F.length("_p"))
        .select("action", F.concat("_h", "_p").alias("rule"), "_rank", digest.alias("_rule_digest"))
        .withColumn("_short", F.substring("_rule_digest", 1, short_hex))
    )
    best = (
        expressions.join(known, "_short")
        .where(F.col("_digest") == F.col("_rule_digest"))
        .groupBy("_host", "_path")
        .agg(F.max(F.struct("_rank", F.col("action").alias("a"), F.col("rule").alias("r"))).alias("_best"))
    )
    return base.join(best, ["_host", "_path"], "left").select(
        F.col("_id").alias(id_col),
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.r").alias("rule"),
        F.coalesce("_best.a", F.lit(default)).alias("verdict"),
    )

"""URL filtering by expressions: host suffixes and path prefixes, looked up by hash.

A rule is a host and the start of a path.  Every URL is expanded into the expressions that a rule
could have been written as: its host's suffixes at label boundaries, times its path's prefixes.
Only label counts and prefix lengths that occur among the rules are expanded, so the expansion is
bounded by the rules, not by the URL.  Expressions meet rules by an equi-join on the first four
bytes of the SHA-256 digest; the whole digest is then compared, and the longest rule decides.

One pass over the pages: the only exchange carries a row for each page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import after_scheme, host_of

#: A rule list of up to so many rows (some 30 MB) is broadcast; a longer one is joined by shuffling.
BROADCAST_RULES = 200_000


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """rules: (verdict, 'host/path') pairs; a rule's host ends at the first '/', its path starts there."""
    rows = [(verdict, rule.split("/", 1)[0], "/" + rule.split("/", 1)[1], rule) for verdict, rule in rules]
    return spark.createDataFrame(rows, "verdict string, host string, path string, rule string")


def judge(
    pages: DataFrame, rules: DataFrame, url: str = "url", page_id: str = "page_id", otherwise: str = "allow"
) -> DataFrame:
    """One row per page: page_id, host, path, rule (null if none fits), verdict.

    rules has verdict, host (lower case), path (starts with '/') and rule (its text).  A rule fits its host and all
    subdomains when the page's path starts with the rule's.  The longest rule (host and path
    together, then host) wins; rules of the same host and path: 'block' goes before others.  A URL that
    is null or has no '://' has an empty host and path and gets `otherwise`, as does one that no
    rule fits.  Repeated pages give repeated rows; other columns are ignored.
    """
    n_rules, labels, lengths = rules.agg(
        F.count(F.lit(1)),
        F.collect_set(F.size(F.split("host", r"\."))),
        F.collect_set(F.length("path")),
    ).first()
    seen = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(page_id).alias("page_id"), after_scheme(F.col(url)).alias("rest")).select(
        "rid",
        "page_id",
        host_of(F.col("rest")).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -k) for k in sorted(labels)] or [F.lit("")]))
    prefixes = F.array_distinct(F.array(*[F.substring("path", 1, k) for k in sorted(lengths)] or [F.lit("")]))
    wide = seen.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
    digest = F.sha2(F.concat_ws("\n", "suffix", "prefix"), 256)
    wide = wide.select("rid", "page_id", "host", "path", digest.alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    known = rules.select(
        F.sha2(F.concat_ws("\n", "host", "path"), 256).alias("full"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"),
            F.length("host").alias("host_size"),
            (F.col("verdict") == "block").alias("blocks"),
            "rule",
            "verdict",
        ).alias("hit"),
    ).withColumn("short", F.substring("full", 1, 8))
    if n_rules <= BROADCAST_RULES:
        known = F.broadcast(known)
    met = wide.join(known, "short", "left").withColumn("hit", F.when(F.col("full") == F.col("digest"), F.col("hit")))
    best = met.groupBy("rid", "page_id", "host", "path").agg(F.max("hit").alias("hit"))
    return best.select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(otherwise)).alias("verdict")
    )

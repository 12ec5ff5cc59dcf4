"""URL filter: host-suffix and path-prefix expressions joined to rules on short hash prefixes.

A url is expanded into every (host suffix, path prefix) expression whose label count and path
length some rule has.  Expressions meet rules in an equi-join on the first 32 bits of their
SHA-256; the full digest then confirms the match, and the longest rule decides.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and
gets the default verdict.  Repeated rows are judged row by row.  Of two verdicts for the same
rule, block wins.  An empty rule table leaves every url with the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmentflow.llm.columns import column

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PREFIX_HEX = 8
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Rules are broadcast up to this many rows (about 200 bytes each); beyond it they are shuffled.
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def prepare_rules(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) with the rule's text, digest and short hash; one row per rule."""
    return (
        rules.where(F.col("host").isNotNull() & F.col("verdict").isin("allow", "block"))
        .select(
            F.translate("host", UPPER, UPPER.lower()).alias("rule_host"),
            F.coalesce("path", F.lit("")).alias("rule_path"),
            (F.col("verdict") == "block").alias("is_block"),
        )
        .groupBy("rule_host", "rule_path")
        .agg(F.max("is_block").alias("is_block"))
        .withColumn("rule_text", F.concat("rule_host", "rule_path"))
        .withColumn("rule_digest", F.sha2("rule_text", 256))
        .withColumn("rule_key", F.substring("rule_digest", 1, PREFIX_HEX))
    )


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """All host suffixes of the given label counts, each with all path prefixes of the given lengths."""
    parts = F.split(host, r"\.", -1)

    def suffix(n: Column) -> Column:
        return F.array_join(F.slice(parts, F.size(parts) - n + 1, n), ".")

    hosts = F.transform(
        F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: (n <= F.size(parts)) & (host != "")), suffix
    )
    ends = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    return F.flatten(
        F.transform(hosts, lambda h: F.transform(ends, lambda n: F.concat(h, F.substring(path, F.lit(1), n))))
    )


def judge_urls(
    pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow"
) -> DataFrame:
    """One row (id, host, path, rule, verdict) per input row."""
    ready = prepare_rules(rules)
    # Distinct shapes of rules: label counts and path lengths are bounded by the longest url allowed.
    shapes = ready.agg(
        F.collect_set(F.size(F.split("rule_host", r"\.", -1))).alias("labels"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
        F.count("*").alias("n"),
    ).first()
    base = pages.select(
        F.monotonically_increasing_id().alias("row_key"),
        column(id_col).alias("page_key"),
        host_of(column(url_col)).alias("host"),
        path_of(column(url_col)).alias("path"),
    )
    if not shapes.n:
        return base.select(
            F.col("page_key").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"),
            F.lit(default).alias("verdict"),
        )
    expanded = base.select(
        "*",
        F.explode_outer(
            _expressions(F.col("host"), F.col("path"), sorted(shapes.labels), sorted(shapes.lengths))
        ).alias("expression"),
    ).withColumn("digest", F.sha2("expression", 256))
    fitting = F.broadcast(ready) if shapes.n <= BROADCAST_RULES else ready
    joined = expanded.join(fitting, F.substring("digest", 1, PREFIX_HEX) == F.col("rule_key"), "left")
    confirmed = (F.col("digest") == F.col("rule_digest")) & (F.col("expression") == F.col("rule_text"))
    best = F.max(
        F.when(
            confirmed,
            F.struct(
                F.length("rule_text").alias("length"), F.length("rule_host").alias("host_length"), "is_block",
                F.col("rule_text").alias("rule"),
            ),
        )
    ).alias("best")
    return (
        joined.groupBy("row_key", "page_key", "host", "path")
        .agg(best)
        .select(
            F.col("page_key").alias(id_col),
            "host",
            "path",
            F.col("best.rule").alias("rule"),
            F.when(F.col("best").isNull(), default)
            .when(F.col("best.is_block"), "block")
            .otherwise("allow")
            .alias("verdict"),
        )
    )

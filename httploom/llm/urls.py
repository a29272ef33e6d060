"""URL filters: host-suffix and path-prefix expressions, joined to rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from httploom.functions.text import let

from . import base

_LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *_LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """All (host suffix, path prefix) structs of a URL, for the prefix lengths that rules have."""
    labels = F.split(host, r"\.")
    suffixes = let(
        labels,
        lambda parts: F.transform(
            F.sequence(F.lit(1), F.size(parts)), lambda at: F.array_join(F.slice(parts, at, F.size(parts)), ".")
        ),
    )
    fitting = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(
        F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.struct(h.alias("rule_host"), p.alias("rule_path"))))
    )


def _digest(host: Column, path: Column) -> Column:
    # A host has no slash and a path is empty or begins with one, so the joined text is unambiguous.
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def judge(
    urls: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
    prefix_digits: int = 8,
    broadcast_bytes: int = base.BROADCAST_BYTES,
) -> DataFrame:
    """``(id, host, path, rule, verdict)`` per URL row.

    ``rules`` has ``(host, path, verdict)``. A rule fits its host and all subdomains where the URL's path begins
    with the rule's (an empty path fits all). The longest rule wins (characters of host and path; then the longer
    host); of equal rules with both verdicts ``block`` wins. URLs without a rule get ``default`` and a null rule.

    Distinct (host, path) pairs are expanded into host suffixes times the path lengths that occur in rules; each
    expression meets the rules on the first ``prefix_digits`` hex digits of its SHA-256, and a match counts once the
    whole digest agrees. Rules are broadcast when their hosts and paths take at most ``broadcast_bytes``; more rules
    join by shuffle on the prefix, where Spark splits a hot prefix (an inner join).

    Null and scheme-less URLs have empty host and path (which a rule with both empty would fit); null ids and
    repeated rows stay, one result row each; no rules or no URLs work; rules with a null host, path or verdict
    are ignored, as are other columns of either table.
    """
    pages = urls.select(F.col(id_col).alias("id"), host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    listed = (
        rules.select(
            F.translate(F.col("host"), *_LOWER).alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict")
        )
        .dropna()
        .groupBy("rule_host", "rule_path")
        .agg(F.max("rule_verdict").alias("rule_verdict"))
        .withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path")))
        .select(F.substring("digest", 1, prefix_digits).alias("prefix"), "digest", "rule_verdict")
    )
    # At most as many lengths as the longest rule path has characters.
    lengths = sorted(r[0] for r in rules.select(F.length("path").alias("n")).dropna().distinct().collect()) or [0]
    if base.fits_broadcast(rules, F.length("host") + F.length("path") + F.lit(80), broadcast_bytes):
        listed = F.broadcast(listed)
    targets = pages.select("host", "path").distinct()
    expanded = (
        targets.select("host", "path", F.explode(_expressions(F.col("host"), F.col("path"), lengths)).alias("e"))
        .select("host", "path", "e.*")
        .withColumn("full", _digest(F.col("rule_host"), F.col("rule_path")))
        .withColumn("prefix", F.substring("full", 1, prefix_digits))
    )
    matched = expanded.join(listed, "prefix").where(F.col("full") == F.col("digest"))
    best = matched.groupBy("host", "path").agg(
        F.max(
            F.struct(
                (F.length("rule_host") + F.length("rule_path")).alias("n"),
                F.length("rule_host").alias("n_host"),
                F.concat("rule_host", "rule_path").alias("rule"),
                F.col("rule_verdict").alias("verdict"),
            )
        ).alias("best")
    )
    return pages.join(best, ["host", "path"], "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )

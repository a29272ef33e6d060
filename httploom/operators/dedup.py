"""Deduplication, capture union, redaction of items, and comparison of two captures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http, jsonx, names, redact, urls
from ..functions import text as tx
from ..session import stored
from . import ordering


def with_content_key(items: DataFrame, out: str = "content_key") -> DataFrame:
    """Fixed-width key over url, request hash and response hash."""
    response = F.sha2(F.col("response_raw").cast("binary"), 256)
    return items.withColumn(out, tx.digest_key(F.col("url"), F.col("sha256"), response))


def dedupe(items: DataFrame) -> DataFrame:
    """Keep the first item of each (url, request, response); a changed response is a new item."""
    keyed = with_content_key(items)
    return ordering.first_per_group(keyed, ["content_key"], "index").drop("content_key")


def union_captures(proxy: DataFrame, site_map: DataFrame) -> DataFrame:
    """All proxy rows, plus site-map rows whose content neither source showed before.

    Site-map rows follow the proxy rows in index order. Only the narrow (key, index) pairs are
    aggregated; each kept site-map row is found again by its unique index.
    """
    history = with_content_key(proxy).select("content_key", F.lit(None).cast("long").alias("index"), F.lit(1).alias("seen"))
    keyed = with_content_key(site_map)
    kept = (
        history.unionByName(keyed.select("content_key", "index", F.lit(0).alias("seen")))
        .groupBy("content_key")
        .agg(F.max("seen").alias("seen"), F.min("index").alias("index"))
        .where(F.col("seen") == 0)
        .select("index")
    )
    fresh = site_map.join(kept, "index", "left_semi")
    numbered = proxy.withColumn("_source", F.lit(0)).unionByName(fresh.withColumn("_source", F.lit(1)))
    # Interleave-free order key: proxy rows first, then site-map rows, both by their own index.
    order = F.col("index") + F.col("_source") * F.lit(1 << 56)
    combined = ordering.sequential_index(numbered.withColumn("_order_key", order).drop("index"), "_order_key", "index")
    return rebuild_slug(combined.drop("_source", "_order_key"))


def rebuild_slug(items: DataFrame) -> DataFrame:
    return items.withColumn("slug", http.slug(F.col("index"), F.col("method"), F.col("path")))


def reindex(items: DataFrame, bits: int = ordering.PIECE_BITS) -> DataFrame:
    """Contiguous 1..n indexes in index order, slugs rebuilt to match."""
    return rebuild_slug(ordering.sequential_index(items, "index", "index", bits=bits)).select(*items.columns)


def tag_sessions(items: DataFrame) -> DataFrame:
    return items.withColumn("session_tag", http.session_tag(F.col("request_headers"), F.col("url")))


def redact_items(items: DataFrame) -> DataFrame:
    """Mask every text field, drop raw bytes, then recompute the slug and request hash."""
    kinds = {
        redact.url: ["url", "path"],
        redact.headers: ["request_headers", "response_headers"],
        redact.message: ["request_body", "response_body", "request_raw", "response_raw"],
        redact.message_body: ["comment", "response_status_line"],
    }
    masked = items.withColumns({name: mask(F.col(name)) for mask, found in kinds.items() for name in found})
    masked = masked.withColumn("response_bytes", F.lit(None).cast("binary"))
    return rebuild_slug(masked).withColumn("sha256", F.sha2(F.col("request_raw").cast("binary"), 256)).select(*items.columns)


# -- comparison of two captures ----------------------------------------------
def _observations(baseline: DataFrame, comparison: DataFrame) -> DataFrame:
    sides = []
    for side, items in ((1, baseline), (2, comparison)):
        sides.append(
            items.select(
                F.lit(side).alias("side"),
                http.origin_endpoint(
                    F.col("method"), F.col("protocol"), F.col("host"), F.col("port"), tx.before(F.col("path"), "?")
                ).alias("endpoint"),
                http.has_any_header(F.col("request_headers"), names.AUTH_HEADERS).alias("has_auth"),
                F.col("status").startswith("2").alias("success"),
                "url",
                "request_body",
            )
        )
    return sides[0].unionByName(sides[1])


def _by_endpoint(observations: DataFrame) -> DataFrame:
    first, second = F.col("side") == 1, F.col("side") == 2
    return observations.groupBy("endpoint").agg(
        F.bool_or(first).alias("in_baseline"),
        F.bool_or(second).alias("in_comparison"),
        F.bool_or(first & F.col("has_auth")).alias("auth_before"),
        F.bool_or(second & F.col("has_auth")).alias("auth_after"),
        F.bool_or(second & F.col("success")).alias("success_after"),
    )


def endpoint_changes(baseline: DataFrame, comparison: DataFrame) -> DataFrame:
    """``(endpoint, change)`` with change new, removed or common: one map-side-combined shuffle."""
    return _by_endpoint(_observations(baseline, comparison)).select(
        "endpoint",
        F.when(~F.col("in_baseline"), F.lit("new")).when(~F.col("in_comparison"), F.lit("removed")).otherwise(F.lit("common")).alias("change"),
    )


def _parameters() -> Column:
    """Names of an item's query and top-level JSON parameters, with their place before them."""
    return F.concat(
        F.transform(urls.query_pairs(urls.query(F.col("url")), keep_blank=True), lambda p: F.concat(F.lit("query:"), p["name"])),
        F.coalesce(F.transform(jsonx.object_keys(F.col("request_body")), lambda k: F.concat(F.lit("json:"), k)), F.array().cast("array<string>")),
    )


def parameter_changes(baseline: DataFrame, comparison: DataFrame) -> DataFrame:
    """Query keys and top-level JSON keys that appeared on or vanished from common endpoints."""
    observed = _observations(baseline, comparison)
    changed = (
        observed.select("endpoint", "side", F.explode(F.array_distinct(_parameters())).alias("parameter"))
        .groupBy("endpoint", "parameter")
        .agg(F.bool_or(F.col("side") == 1).alias("before"), F.bool_or(F.col("side") == 2).alias("after"))
        .where(F.col("before") != F.col("after"))
    )
    common = _by_endpoint(observed).where(F.col("in_baseline") & F.col("in_comparison")).select("endpoint")
    return ordering.lookup_join(changed, common, ["endpoint"], ["parameter"], "left_semi").select(
        "endpoint", "parameter", F.when(F.col("after"), F.lit("new")).otherwise(F.lit("removed")).alias("change")
    )


def authorization_downgrades(baseline: DataFrame, comparison: DataFrame) -> DataFrame:
    """Common endpoints that had an auth header before, none after, and still answered 2xx."""
    return (
        _by_endpoint(_observations(baseline, comparison))
        .where(F.col("auth_before") & ~F.col("auth_after") & F.col("success_after"))
        .select("endpoint")
    )


def capture_diff(baseline: DataFrame, comparison: DataFrame) -> DataFrame:
    """New and removed endpoints, parameter changes and authorization downgrades as one table.

    Each capture is read once: an item gives a row for its endpoint and one for each of its parameters, and the flags of both
    meet in one map-side-combined aggregate. What follows reads its distinct rows.
    """
    observed = _observations(baseline, comparison)
    first, second = F.col("side") == 1, F.col("side") == 2
    none = F.lit(None).cast("string")
    named = F.concat(F.array(none), F.array_distinct(_parameters()))
    flags = {
        "before": first, "after": second, "auth_before": first & F.col("has_auth"), "auth_after": second & F.col("has_auth"),
        "success_after": second & F.col("success"),
    }
    rows = observed.select("endpoint", F.explode(named).alias("parameter"), *[on.alias(name) for name, on in flags.items()])
    seen = stored(rows.groupBy("endpoint", "parameter").agg(*[F.bool_or(name).alias(name) for name in flags]), "seen")
    change = F.when(~F.col("before"), F.lit("new")).when(~F.col("after"), F.lit("removed"))
    ends, parameters = seen.where(F.col("parameter").isNull()), seen.where(F.col("parameter").isNotNull())
    common = ends.where(F.col("before") & F.col("after"))
    changed = parameters.where(change.isNotNull()).select("endpoint", "parameter", F.concat(change, F.lit("_parameter")).alias("change_type"))
    shown = ordering.lookup_join(changed, common.select("endpoint"), ["endpoint"], ["parameter"], "left_semi")
    whole = [
        ends.where(change.isNotNull()).select(F.concat(change, F.lit("_endpoint")).alias("change_type"), "endpoint", F.lit("").alias("parameter")),
        common.where(F.col("auth_before") & ~F.col("auth_after") & F.col("success_after")).select(
            F.lit("authorization_downgrade").alias("change_type"), "endpoint", F.lit("").alias("parameter")
        ),
    ]
    return whole[0].unionByName(whole[1]).unionByName(shown)

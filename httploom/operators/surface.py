"""Attack-surface summaries, site-map tree and API description.

Everything is a map-side-combined aggregate or a distinct; open-ended sets stay rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http, jsonx, names, urls
from ..functions import text as tx
from . import ordering


def _keys(items: DataFrame) -> DataFrame:
    method, path = F.upper(tx.or_else(F.col("method"), "UNKNOWN")), tx.or_else(F.col("path"), "/")
    return items.select(
        "index", "host", "tool",
        method.alias("method"),
        tx.or_else(F.col("status"), "unknown").alias("status"),
        tx.or_else(F.col("session_tag"), "session_anon").alias("session"),
        http.origin_endpoint(method, F.col("protocol"), F.col("host"), F.col("port"), path).alias("endpoint"),
    )


def summary(items: DataFrame) -> DataFrame:
    """Totals: items, unique hosts, tools, endpoints and sessions."""
    return _keys(items).agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_distinct(F.when(F.col("host") != "", F.col("host"))).alias("unique_hosts"),
        F.count_distinct("tool").alias("unique_tools"),
        F.count_distinct("endpoint").alias("unique_endpoints"),
        F.count_distinct("session").alias("unique_sessions"),
    )


def breakdown(items: DataFrame) -> DataFrame:
    """Counts by method, status, session and endpoint as ``(dimension, value, items)``."""
    keys = _keys(items)
    dimensions = ["method", "status", "session", "endpoint"]
    grouped = keys.groupingSets([[d] for d in dimensions], *dimensions).agg(
        F.count(F.lit(1)).alias("items"), *[F.grouping(d).alias(f"_{d}") for d in dimensions]
    )
    dimension, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name in dimensions:
        dimension = F.when(F.col(f"_{name}") == 0, F.lit(name)).otherwise(dimension)
        value = F.when(F.col(f"_{name}") == 0, F.col(name)).otherwise(value)
    return grouped.select(dimension.alias("dimension"), value.alias("value"), "items")


def top_endpoints(items: DataFrame, limit: int = 200) -> DataFrame:
    """Most frequent endpoints, ties by first appearance."""
    return (
        _keys(items)
        .groupBy("endpoint")
        .agg(F.count(F.lit(1)).alias("items"), F.min("index").alias("first_index"))
        .orderBy(F.desc("items"), "first_index")
        .limit(limit)
        .select("endpoint", "items")
    )


def observed_names(items: DataFrame) -> DataFrame:
    """Distinct ``(kind, name)``: auth headers, security headers and secret-named parameters seen."""

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("name")))

    request, response = F.col("request_headers"), F.col("response_headers")
    in_headers = F.flatten(F.transform(request, lambda h: urls.query_pairs(h["value"], keep_blank=True)))
    pairs = F.concat(urls.query_pairs(urls.query(F.col("url")), keep_blank=True), in_headers)
    name = lambda h: h["name"]
    found = F.concat(
        tagged("auth_header", F.transform(F.filter(request, lambda h: F.lower(h["name"]).isin(*names.AUTH_HEADERS)), name)),
        tagged(
            "security_header",
            F.transform(
                F.filter(
                    response,
                    lambda h: F.lower(h["name"]).startswith("x-")
                    | F.lower(h["name"]).isin("content-security-policy", "strict-transport-security"),
                ),
                name,
            ),
        ),
        tagged("sensitive_parameter", F.transform(F.filter(pairs, lambda p: F.lower(p["name"]).isin(*names.SURFACE_SECRET_KEYS)), name)),
    )
    return items.select(F.explode(F.array_distinct(found)).alias("f")).select("f.kind", "f.name").distinct()


def tool_breakdown(items: DataFrame) -> DataFrame:
    """Per tool: items, unique hosts, and the distinct methods as sorted text."""
    base = items.select("tool", tx.or_else(F.col("host"), "unknown").alias("host"), tx.or_else(F.col("method"), "?").alias("method"))
    counts = base.groupBy("tool").agg(F.count(F.lit(1)).alias("items"), F.count_distinct("host").alias("unique_hosts"))
    methods = base.select("tool", "method").distinct().groupBy("tool").agg(
        F.array_join(F.array_sort(F.collect_list("method")), ", ").alias("methods")
    )
    return counts.join(methods, "tool")


def host_summary(items: DataFrame) -> DataFrame:
    """Per host: items and the distinct tools as sorted text."""
    per_pair = items.groupBy(tx.or_else(F.col("host"), "unknown").alias("host"), "tool").agg(F.count(F.lit(1)).alias("n"))
    return per_pair.groupBy("host").agg(
        F.sum("n").alias("items"), F.array_join(F.array_sort(F.collect_list("tool")), ", ").alias("tools")
    )


def distinct_tools(items: DataFrame) -> DataFrame:
    return items.select("tool").distinct()


def distinct_hosts(items: DataFrame) -> DataFrame:
    return items.where(F.col("host") != "").select("host").distinct()


def site_map(items: DataFrame) -> DataFrame:
    """Tree nodes ``(host, node, depth, items)``: every prefix of every item's safe path."""
    segments = items.select(
        http.safe_dirname(tx.or_else(F.col("host"), "unknown")).alias("host"),
        http.path_segments(F.col("path"), F.col("url")).alias("segments"),
    )
    # Roll up identical paths before fanning out to their prefixes.
    paths = segments.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"))
    nodes = paths.select(
        "host", "segments", "n", F.explode(F.sequence(F.lit(1), F.size("segments"))).alias("depth")
    ).select("host", F.array_join(F.slice("segments", F.lit(1), F.col("depth")), "/").alias("node"), "depth", "n")
    return nodes.groupBy("host", "node", "depth").agg(F.sum("n").alias("items"))


# -- API description ---------------------------------------------------------
def _api_rows(items: DataFrame) -> DataFrame:
    method = F.lower(tx.or_else(F.col("method"), "get"))
    code = F.when(F.col("status").rlike(r"^\d{3}$"), F.col("status")).otherwise(F.lit("default"))
    return items.select(
        "index", "url", "request_body", method.alias("method"), code.alias("status"),
        F.concat(urls.scheme(F.col("url")), F.lit("://"), urls.netloc(F.col("url"))).alias("server"),
        tx.or_else(urls.path(F.col("url")), "/").alias("path"),
    ).where(urls.scheme(F.col("url")).isin("http", "https") & (urls.netloc(F.col("url")) != ""))


def api_servers(items: DataFrame) -> DataFrame:
    return _api_rows(items).select("server").distinct()


def api_operations(items: DataFrame) -> DataFrame:
    """Per (path, method): statuses and the schema of the first JSON object body."""
    rows = _api_rows(items).where(F.col("method").isin(*names.SCHEMA_METHODS))
    has_body = (
        F.col("method").isin(*names.SCHEMA_BODY_METHODS)
        & tx.strip(F.col("request_body")).startswith("{")
        & jsonx.is_valid(F.col("request_body"))
    )
    per_status = rows.groupBy("path", "method", "status").agg(
        F.min_by(F.when(has_body, F.col("request_body")), F.when(has_body, F.col("index"))).alias("body"),
        F.min(F.when(has_body, F.col("index"))).alias("body_index"),
    )
    # Statuses are three digits or 'default', so the second level collects a bounded set.
    return per_status.groupBy("path", "method").agg(
        F.array_sort(F.collect_set("status")).alias("statuses"), F.min_by("body", "body_index").alias("body")
    ).select("path", "method", "statuses", jsonx.api_schema(F.col("body")).alias("body_schema"))


def api_parameters(items: DataFrame) -> DataFrame:
    """Distinct query parameter names per (path, method)."""
    rows = _api_rows(items).where(F.col("method").isin(*names.SCHEMA_METHODS))
    named = urls.query_pairs(urls.query(F.col("url")), keep_blank=True)
    return rows.select(
        "path", "method", F.explode(F.array_distinct(F.transform(named, lambda p: p["name"]))).alias("name")
    ).distinct()


# -- corpus profile ----------------------------------------------------------
def corpus_totals(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_distinct(http.endpoint(F.col("method"), F.col("path"))).alias("endpoints"),
        F.count_distinct(F.when(F.col("host") != "", F.col("host"))).alias("hosts"),
    )


def corpus_samples(items: DataFrame, limit: int = 5) -> DataFrame:
    """``(section, rank, value)``: first sorted auth and no-auth endpoints, first errors in order, statuses."""
    endpoint = http.endpoint(F.col("method"), F.col("path"))
    tagged = items.select(
        "index", endpoint.alias("endpoint"), tx.or_else(F.col("status"), "?").alias("status"),
        F.when(http.has_any_header(F.col("request_headers"), names.AUTH_HEADERS), F.lit("auth_endpoint"))
        .otherwise(F.lit("noauth_endpoint"))
        .alias("section"),
    )
    sampled = ordering.smallest_per_group(
        tagged.select("section", F.col("endpoint").alias("value")).distinct(), ["section"], [F.col("value")], limit
    )
    errors = ordering.smallest_per_group(
        tagged.where(F.col("status").rlike("^[45]")).select(
            F.lit("error").alias("section"), F.concat("endpoint", F.lit(" ["), "status", F.lit("]")).alias("value"), "index"
        ),
        ["section"], [F.col("index")], limit,
    ).drop("index")
    statuses = tagged.select(F.lit("status").alias("section"), F.col("status").alias("value")).distinct().withColumn("rank", F.lit(0))
    return sampled.unionByName(errors).unionByName(statuses).select("section", F.col("rank").cast("long").alias("rank"), "value")

"""Row filters over items. Invalid user input fails instead of matching nothing."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http, jsonx, names, urls
from ..functions import text as tx
from . import ordering


def by_tools(items: DataFrame, tools: str = "") -> DataFrame:
    """Tool in a comma-separated list, case-insensitive; an empty list keeps everything.

    Items hold lower-case tools, so this is a plain comparison the scan (or partition pruning) can use.
    """
    wanted = tx.csv_values(tools)
    return items.where(F.col("tool").isin(*wanted)) if wanted else items


def by_status(items: DataFrame, statuses: str = "") -> DataFrame:
    """Exact codes or classes such as ``4xx``; an empty status never matches a filter."""
    wanted = tx.csv_values(statuses)
    if not wanted:
        return items
    families = [w[0] for w in wanted if re.fullmatch(r"\dxx", w)]
    matches = [F.col("status").isin(*wanted), *[F.col("status").startswith(digit) for digit in families]]
    return items.where((F.col("status") != "") & http.any_of(*matches))


def by_time(items: DataFrame, start: str = "", end: str = "") -> DataFrame:
    """Inclusive range; a date-only end covers that whole day; rows without a time are kept."""
    start, end = (start or "").strip(), (end or "").strip()
    if not start and not end:
        return items
    # Two literals parsed once on the driver side of the plan, so the comparison can reach Parquet.
    row = items.sparkSession.range(1).select(
        http.flexible_time(F.lit(start)).alias("start"),
        F.when(
            F.lit(end).rlike(r"^\d{4}-\d{2}-\d{2}$"),
            http.flexible_time(F.lit(end)) + F.expr("INTERVAL 1 DAY") - F.expr("INTERVAL 0.000001 SECOND"),
        ).otherwise(http.flexible_time(F.lit(end))).alias("end"),
        (http.flexible_time(F.lit(start)) > http.flexible_time(F.lit(end))).alias("reversed"),
    ).first()
    if row["reversed"]:
        raise ValueError("From time must precede To time")
    keep = F.lit(True)
    if row["start"] is not None:
        keep = keep & (F.col("time") >= F.lit(row["start"]))
    if row["end"] is not None:
        keep = keep & (F.col("time") <= F.lit(row["end"]))
    return items.where(F.col("time").isNull() | keep)


def _text_match(actual: Column, wanted: str, exact: bool) -> Column:
    if exact:
        return F.lower(actual) == wanted.lower()
    return F.lower(actual).contains(wanted.lower())


def by_parameter(items: DataFrame, name: str = "", value: str = "", exact: bool = False) -> DataFrame:
    """Items carrying a parameter, by name and/or value.

    Looks at the query, form body, nested JSON, cookies, non-standard headers and, when no name
    is given, path segments. All sources are tested in place, so nothing is shuffled.
    """
    if not name and not value:
        return items

    def pair(p: Column) -> Column:
        tests = []
        if name:
            tests.append(_text_match(p["name"], name, exact))
        if value:
            tests.append(_text_match(p["value"], value, exact))
        return tests[0] if len(tests) == 1 else tests[0] & tests[1]

    body = F.col("request_body")
    trimmed = tx.strip(body)
    is_form = F.lower(http.header_value(F.col("request_headers"), "content-type")).contains("form") | (
        body.contains("=") & ~trimmed.startswith("{")
    )
    form = F.when(is_form, urls.query_pairs(body, keep_blank=True))
    headers = F.filter("request_headers", lambda h: ~F.lower(h["name"]).isin(*names.SEARCH_STANDARD_HEADERS))
    tests = [
        F.exists(urls.query_pairs(urls.query(F.col("url")), keep_blank=True), pair),
        F.coalesce(F.exists(form, pair), F.lit(False)),
        F.exists(http.cookie_pairs(F.col("request_headers")), pair),
        F.exists(headers, pair),
        F.exists(jsonx.members(body), pair),
    ]
    if not name:
        tests.append(F.exists(F.split("path", "/"), lambda s: (s != "") & _text_match(s, value, exact)))
    return items.where(http.any_of(*tests))


def by_regex(items: DataFrame, pattern: str = "", target: str = "both") -> DataFrame:
    """Case-insensitive pattern on the start line, each header line or the body."""
    if not pattern:
        return items
    if target not in ("both", "request", "response"):
        raise ValueError("target must be both, request or response")
    check_pattern(items, pattern)
    insensitive = "(?i)" + pattern

    def side(start: Column, headers: str, body: str) -> Column:
        return http.any_of(
            (start != "") & start.rlike(insensitive),
            F.exists(headers, lambda h: F.concat(h["name"], F.lit(": "), h["value"]).rlike(insensitive)),
            (F.col(body) != "") & F.col(body).rlike(insensitive),
        )

    sides = []
    if target != "response":
        sides.append(side(http.first_line(http.head(F.col("request_raw"))), "request_headers", "request_body"))
    if target != "request":
        sides.append(side(F.col("response_status_line"), "response_headers", "response_body"))
    return items.where(http.any_of(*sides))


def first_items(items: DataFrame, max_items: int | None = None) -> DataFrame:
    """The first ``max_items`` by index; no limit unless asked for."""
    return items if max_items is None else items.orderBy("index").limit(max_items)


def check_pattern(items: DataFrame, pattern: str) -> None:
    """Reject a bad pattern before any data is read."""
    try:
        items.sparkSession.range(1).select(F.lit("").rlike(pattern)).first()
    except Exception as error:
        raise ValueError("Invalid regex pattern") from error


def in_scope(items: DataFrame, scope: DataFrame) -> DataFrame:
    """Keep items whose (protocol, host) a scope row includes and whose path starts with its prefix.

    ``scope``: protocol, host, prefix. No matching row means out of scope.
    """
    rules = ordering.broadcast_if_small(
        scope.select(F.lower("protocol").alias("_protocol"), F.lower("host").alias("_host"), F.col("prefix").alias("_prefix"))
    )
    matches = (
        (F.lower("protocol") == F.col("_protocol"))
        & (F.lower("host") == F.col("_host"))
        & F.col("path").startswith(F.col("_prefix"))
    )
    return items.join(rules, matches, "left_semi")


def by_hosts(items: DataFrame, hosts: list[str]) -> DataFrame:
    return items.where(F.lower("host").isin(*[h.lower() for h in hosts]))


def selected_hosts(items: DataFrame) -> DataFrame:
    """Distinct hosts ignoring case; the spelling seen first is kept."""
    return (
        items.where(F.col("host") != "")
        .groupBy(F.lower("host").alias("host_key"))
        .agg(F.min_by("host", "index").alias("host"))
        .select("host")
    )


def items_by_tool(items: DataFrame, tool: str) -> DataFrame:
    return items.where(F.col("tool") == tool)


def items_by_host(items: DataFrame, host: str) -> DataFrame:
    return items.where(F.col("host") == host)


def validity(items: DataFrame, max_url: int | None = None) -> DataFrame:
    """Add ``reject_reason`` (null for usable rows): method list, URL length, http(s) only."""
    reason = (
        F.when(~F.upper("method").isin(*names.MAPPED_METHODS), F.lit("Unsupported item schema or method"))
        .when(
            F.col("url").isNull() | (F.lit(False) if max_url is None else F.length("url") > max_url),
            F.lit("Traffic URL is invalid" if max_url is None else f"Traffic URL exceeds the {max_url}-character limit or is invalid"),
        )
        .when(~urls.scheme(F.col("url")).isin("http", "https"), F.lit("Non-HTTP URL"))
    )
    return items.withColumn("reject_reason", reason)


def valid_items(items: DataFrame, max_url: int | None = None) -> DataFrame:
    return validity(items, max_url).where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected_items(items: DataFrame, max_url: int | None = None) -> DataFrame:
    return validity(items, max_url).where(F.col("reject_reason").isNotNull())

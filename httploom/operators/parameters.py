"""Parameter index over query, form, JSON, cookie and header inputs.

The exploded ``parameters`` view feeds every result. Unbounded sets (endpoints, hosts of one
parameter) are long tables, never arrays: a header sent by every client would otherwise put a
whole capture's endpoints into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http, jsonx, names, urls
from ..functions import text as tx
from . import ordering

EXAMPLES = 3
KEYS = ["source", "key"]


def _tagged(source: str, pairs: Column, value_of) -> Column:
    return F.transform(
        pairs, lambda p: F.struct(F.lit(source).alias("source"), p["name"].alias("name"), value_of(p).alias("value"))
    )


def parameters(items: DataFrame, json_limit: int | None = None, header_limit: int | None = None) -> DataFrame:
    """One row per input occurrence: source, key, name, value, endpoint, host, index, position.

    Values of JSON members and headers are whole unless a limit cuts them to so many characters.
    """
    cut = lambda limit: lambda p: p["value"] if limit is None else F.substring(p["value"], 1, limit)
    body, headers = F.col("request_body"), F.col("request_headers")
    is_form = F.lower(http.header_value(headers, "content-type")).contains("form") | (
        body.contains("=") & ~tx.strip(body).startswith("{")
    )
    none = F.array().cast("array<struct<source:string,name:string,value:string>>")
    custom = F.filter(headers, lambda h: ~F.lower(h["name"]).isin(*names.STANDARD_HEADERS))
    found = F.concat(
        _tagged("query", urls.query_pairs(urls.query(F.col("url")), keep_blank=True), lambda p: p["value"]),
        F.when(
            is_form & (body != ""), _tagged("body_form", urls.query_pairs(body, keep_blank=True), lambda p: p["value"])
        ).otherwise(none),
        _tagged("json_body", jsonx.flatten(body), cut(json_limit)),
        _tagged("cookie", http.cookie_pairs(headers), lambda p: F.lit("(value)")),
        _tagged("header", custom, cut(header_limit)),
    )
    return items.select(
        "index", "host", http.endpoint(F.col("method"), F.col("path")).alias("endpoint"), F.posexplode(found).alias("pos", "p")
    ).select(
        F.col("p.source").alias("source"), F.lower("p.name").alias("key"), F.col("p.name").alias("name"),
        F.col("p.value").alias("value"), "endpoint", "host", "index", "pos",
    )


def _arrival() -> Column:
    """Order of (index, pos) as one number: its minimum is a hash aggregate, that of a struct would sort all rows of a task."""
    number = lambda column, digits: column.cast(f"decimal({digits},0)")
    return number(F.col("index"), 20) * number(F.lit(1 << 31), 10) + number(F.col("pos"), 10)


def index(parameter_rows: DataFrame) -> DataFrame:
    """One row per (source, lower name): first spelling, occurrences, endpoint and host counts, sensitivity."""
    # One row per (parameter, spelling, endpoint, host) first: the distinct counts then expand those rows only.
    places = parameter_rows.groupBy(*KEYS, "name", "endpoint", "host").agg(F.count(F.lit(1)).alias("n"), F.min(_arrival()).alias("first"))
    totals = places.groupBy(*KEYS).agg(
        F.sum("n").alias("occurrences"),
        F.min(F.struct("first", "name"))["name"].alias("name"),
        F.count_distinct("endpoint").alias("endpoint_count"),
        F.count_distinct("host").alias("host_count"),
    )
    shown = examples(parameter_rows).groupBy(*KEYS).agg(
        F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("shown")  # at most EXAMPLES per key
    )
    return totals.join(shown, KEYS, "left").select(
        "name", "source", "occurrences",
        F.coalesce(F.transform("shown", lambda e: e["value"]), F.array().cast("array<string>")).alias("example_values"),
        "endpoint_count", "host_count", http.is_sensitive_name(F.col("name")).alias("is_sensitive"), "key",
    )


def examples(parameter_rows: DataFrame, limit: int = EXAMPLES, value_limit: int | None = None) -> DataFrame:
    """First distinct non-empty values of each parameter in arrival order, cut to ``value_limit`` characters where that is set."""
    value = F.col("value") if value_limit is None else F.substring("value", 1, value_limit)
    first_seen = (
        parameter_rows.where(F.col("value") != "")
        .groupBy(*KEYS, value.alias("value"))
        .agg(F.min(_arrival()).alias("arrival"))
    )
    return ordering.smallest_per_group(first_seen, KEYS, [F.col("arrival")], limit).select(*KEYS, "rank", "value")


def endpoints(parameter_rows: DataFrame) -> DataFrame:
    """Every (parameter, endpoint) pair with its occurrence count."""
    return parameter_rows.groupBy(*KEYS, "endpoint").agg(F.count(F.lit(1)).alias("occurrences"))


def hosts(parameter_rows: DataFrame) -> DataFrame:
    """Every (parameter, host) pair with its occurrence count."""
    return parameter_rows.groupBy(*KEYS, "host").agg(F.count(F.lit(1)).alias("occurrences"))


def sorted_index(parameter_index: DataFrame) -> DataFrame:
    """Most frequent first, then by name."""
    return parameter_index.orderBy(F.desc("occurrences"), "name", "source")


def summary(items: DataFrame, parameter_index: DataFrame) -> DataFrame:
    """Unique parameters per source, with the total over all sources."""
    return parameter_index.rollup("source").agg(F.count(F.lit(1)).alias("parameters")).select(
        F.coalesce("source", F.lit("all")).alias("source"), "parameters"
    )

"""User journeys (state transitions) and identifier flow between responses and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import http, names, urls
from ..session import stored
from . import ordering

FLOW_KEYS = ["host", "session", "value"]


def _session():
    return http.session_key(F.col("session_tag"), F.col("request_headers"), F.col("url")).alias("session")


def transitions(items: DataFrame, bits: int = ordering.PIECE_BITS) -> DataFrame:
    """Counts of (src, dst) generalised endpoints following each other within a host's session."""
    steps = items.select(
        "host",
        http.journey_session(_session(), F.col("request_headers")).alias("session"),
        "index",
        http.generalise(http.endpoint(F.col("method"), F.col("path"))).alias("endpoint"),
    )
    pairs = ordering.consecutive_pairs(steps, ["host", "session"], "index", "endpoint", bits)
    return pairs.where(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("transitions"))


def drop_noise(counted: DataFrame, least: int = 2) -> DataFrame:
    """Keep transitions seen ``least`` times; captures of a few items, where each is seen once, pass 1."""
    return counted.where(F.col("transitions") >= least)


def top_transitions(counted: DataFrame, limit: int = 50) -> DataFrame:
    return counted.orderBy(F.desc("transitions"), "src", "dst").limit(limit)


def _json_ids(body: str):
    """Values of id-named JSON members in text, quoted or numeric."""
    quoted = F.regexp_extract_all(body, F.lit(names.JSON_ID_PATTERN), 1)
    digits = F.regexp_extract_all(body, F.lit(names.JSON_ID_PATTERN), 2)
    return F.zip_with(quoted, digits, lambda q, d: F.when(q != "", q).otherwise(d))


def response_values(items: DataFrame) -> DataFrame:
    """First item and endpoint whose response carried each identifier, per host and session."""
    uuids = F.regexp_extract_all("response_body", F.lit(names.UUID_PATTERN), 0)
    found = F.array_distinct(F.concat(uuids, _json_ids("response_body")))
    return (
        items.where(F.col("response_body") != "")
        .withColumn("session", _session())
        .select(
            "host", "session", "session_tag", "index", http.endpoint(F.col("method"), F.col("path")).alias("endpoint"),
            F.explode(found).alias("value"),
        )
        .groupBy(*FLOW_KEYS)
        .agg(
            F.min("index").alias("source_item"), F.min_by("endpoint", "index").alias("source_endpoint"), F.min("session_tag").alias("session_tag")
        )
    )


def request_values(items: DataFrame) -> DataFrame:
    """Every identifier-like input of a request with the place it was used."""

    def tagged(context, values):
        return F.transform(values, lambda v: F.struct(context(v).alias("context"), v.alias("value")))

    in_path = tagged(lambda v: F.lit("path_param"), F.split("path", "/"))
    in_query = F.transform(
        urls.query_pairs(urls.query(F.col("url"))),
        lambda p: F.struct(F.concat(F.lit("query:"), p["name"]).alias("context"), p["value"].alias("value")),
    )
    in_body = tagged(lambda v: F.lit("body_json"), _json_ids("request_body"))
    used = F.filter(F.concat(in_path, in_query, in_body), lambda u: u["value"] != "")
    return items.withColumn("session", _session()).select(
        "host", "session", F.col("index").alias("target_item"),
        http.endpoint(F.col("method"), F.col("path")).alias("target_endpoint"), F.posexplode(used).alias("pos", "u"),
    ).select(
        "host", "session", "target_item", "target_endpoint", "pos",
        F.col("u.context").alias("target_context"), F.col("u.value").alias("value"),
    )


def id_flow(items: DataFrame, hot_rows: int = ordering.HOT_ROWS) -> DataFrame:
    """Edges from the first response carrying a value to each later request using it.

    The source side is one row per (host, session, value); hot values are salted on the target side, which is stored because
    it is counted and joined.
    """
    uses = stored(request_values(items), "uses")
    joined = ordering.lookup_join(uses, response_values(items), FLOW_KEYS, ["target_item", "pos"], hot_rows=hot_rows)
    return joined.where(F.col("source_item") < F.col("target_item")).select(
        "value", "source_item", "source_endpoint", "target_item", "target_endpoint", "target_context"
    )


def endpoint_flow(edges: DataFrame) -> DataFrame:
    """Distinct generalised (source, target) endpoint pairs of the id-flow edges."""
    return (
        edges.select(
            http.generalise(F.col("source_endpoint")).alias("source"), http.generalise(F.col("target_endpoint")).alias("target")
        )
        .where(F.col("source") != F.col("target"))
        .distinct()
    )

"""Observed endpoints, route matching and router mount composition."""

from __future__ import annotations

import re
from typing import NamedTuple
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http, names, redact, urls
from ..functions import text as tx
from ..session import scratch, stored
from . import ordering

ENDPOINT_KEYS = ["method", "origin", "path"]


# -- endpoints and samples ---------------------------------------------------
def _session() -> Column:
    return http.session_key(F.col("session_tag"), F.col("request_headers"), F.col("url")).alias("session")


def _visits(items: DataFrame) -> DataFrame:
    url = F.col("url")
    return items.select(
        F.upper("method").alias("method"), urls.origin(url).alias("origin"), tx.or_else(urls.path(url), "/").alias("path"),
        "status", _session(), "index",
    )


def endpoints(items: DataFrame, bits: int = ordering.PIECE_BITS) -> DataFrame:
    """One row per (method, origin, path): id by first appearance, captures, distinct status/session variants.

    The endpoints are stored before they are numbered, so that items are read once however often the result is used.
    """
    per_variant = _visits(items).groupBy(*ENDPOINT_KEYS, "status", "session").agg(
        F.count(F.lit(1)).alias("n"), F.min("index").alias("first_index")
    )
    rolled = per_variant.groupBy(*ENDPOINT_KEYS).agg(
        F.sum("n").alias("captures"), F.count(F.lit(1)).alias("variants"), F.min("first_index").alias("first_index")
    )
    numbered = ordering.sequential_index(stored(rolled, "endpoints"), "first_index", "number", bits=bits)
    return numbered.withColumn("endpoint_id", F.concat(F.lit("E"), "number"))


def session_groups(items: DataFrame, bits: int = ordering.PIECE_BITS) -> DataFrame:
    """Anonymous ``session-group-n`` names for session keys, by first appearance."""
    firsts = items.where(F.col("session_tag") != "").groupBy(_session()).agg(
        F.min("index").alias("first_index"), F.min("session_tag").alias("session_tag")
    )
    return _named_groups(firsts, bits).select("session", "session_tag", "session_group")


def _named_groups(firsts: DataFrame, bits: int = ordering.PIECE_BITS) -> DataFrame:
    numbered = ordering.sequential_index(firsts, "first_index", "number", bits=bits)
    return numbered.withColumn("session_group", F.concat(F.lit("session-group-"), "number"))


def samples(items: DataFrame, limit: int = 3) -> DataFrame:
    """First item of each (status, session) variant, at most ``limit`` variants per endpoint.

    Items are read once; the names of the sessions come from the variants, which hold each session's first item.
    """
    visits = _visits(items).groupBy(*ENDPOINT_KEYS, "status", "session").agg(F.min("index").alias("index"))
    variants = stored(visits, "variants")
    chosen = ordering.smallest_per_group(variants, ENDPOINT_KEYS, [F.col("index")], limit)
    firsts = variants.where(F.col("session") != "").groupBy("session").agg(F.min("index").alias("first_index"))
    groups = _named_groups(firsts).select("session", "session_group")
    named = ordering.lookup_join(chosen, groups, ["session"], ["index"], "left")
    return named.select(
        *ENDPOINT_KEYS, F.col("rank").cast("long").alias("rank"), "status",
        F.coalesce("session_group", F.lit("unknown")).alias("session_group"), "index",
    )


def sample_records(items: DataFrame, limit: int = 3, body_limit: int | None = None) -> DataFrame:
    """Samples with masked content; bodies are cut at ``body_limit`` where a caller sets it, header JSON never."""

    def header_text(column: str) -> Column:
        return F.to_json(F.map_from_entries(redact.headers(F.col(column))))

    def body_text(column: str) -> Column:
        masked = redact.message(F.col(column))
        return masked if body_limit is None else F.substring(masked, 1, body_limit)

    chosen = stored(samples(items, limit), "samples")
    fields = ["slug", "url", *(f"{side}_{part}" for side in ("request", "response") for part in ("raw", "headers", "body"))]
    # Only the samples' items are masked: the content is made after the join.
    return items.select("index", *fields).join(chosen, "index").select(
        *["index", *(c for c in chosen.columns if c != "index")],
        tx.content_id("T", F.col("slug")).alias("evidence_id"),
        F.col("slug").alias("file"),
        F.sha2(F.concat("request_raw", F.lit("\n"), "response_raw").cast("binary"), 256).alias("hash"),
        redact.url(F.col("url")).alias("url"),
        header_text("request_headers").alias("request_headers"),
        body_text("request_body").alias("request_body"),
        header_text("response_headers").alias("response_headers"),
        body_text("response_body").alias("response_body"),
    )


# -- rewrites ----------------------------------------------------------------
class Rewrite(NamedTuple):
    """Paths of ``origin`` below ``head`` (all, if it is empty) are seen by the application below ``target``."""

    origin: str
    head: str
    target: str


def _web_origin(text: str) -> bool:
    """Whether the text is a scheme and a lower-case host with an optional port, and nothing else."""
    try:
        parts = urlsplit(text)
        whole = parts.scheme in ("http", "https") and parts.hostname and parts.username is None and (parts.port or True)
    except ValueError:
        return False
    return bool(whole) and text == f"{parts.scheme}://{parts.netloc}" and text == text.lower() and not re.search(r"\s", text)


def _absolute_path(text: str) -> bool:
    return text[:1] == "/" and not set("?#") & set(text) and ".." not in text


_CHECKED = {"origin": _web_origin, "from": _absolute_path, "to": _absolute_path}


def parse_rewrites(rules: list[dict], max_rules: int | None = None) -> list[Rewrite]:
    """The rules ``{"origin", "from", "to"}`` as ``Rewrite``, longest head first; all that is wrong with them is one error."""
    if not isinstance(rules, list):
        raise ValueError("rewrites: a list is expected")
    wrong = [] if max_rules is None or len(rules) <= max_rules else [f"{len(rules)} rules, {max_rules} are allowed"]
    parsed: dict[tuple[str, str], Rewrite] = {}
    for number, rule in enumerate(rules, 1):
        bad = [name for name, ok in _CHECKED.items() if not isinstance(rule, dict) or not isinstance(rule.get(name), str) or not ok(rule[name])]
        if bad:
            wrong.append(f"rule {number}: {', '.join(bad)}")
            continue
        made = Rewrite(rule["origin"], rule["from"].rstrip("/"), rule["to"])
        if parsed.setdefault(made[:2], made) is not made:
            wrong.append(f"rule {number}: {made.origin}{made.head or '/'} again")
    if wrong:
        raise ValueError("rewrites: " + "; ".join(wrong))
    return sorted(parsed.values(), key=lambda made: len(made.head), reverse=True)


def rewrite_paths(endpoint_rows: DataFrame, rewrites: list[dict]) -> DataFrame:
    """Add ``effective_path``: the longest matching prefix of the endpoint's own origin is replaced.

    Rules are typed in by a user, so they are one conditional expression and no join.
    """
    effective = F.col("path")
    for origin, head, target in reversed(parse_rewrites(rewrites)):
        hit = (F.col("origin") == origin) & (F.lit(not head) | (F.col("path") == head) | F.col("path").startswith(head + "/"))
        rest = F.col("path").substr(F.lit(len(head) + 1), F.length("path"))
        effective = F.when(hit, F.regexp_replace(F.concat(F.lit(f"/{target}/"), rest), r"/{2,}", "/")).otherwise(effective)
    return endpoint_rows.withColumn("effective_path", effective)


# -- route matching ----------------------------------------------------------
_CATCH_ALL = r"^(?:\*\w+\??|\*\*|<path:\w+>)$"
_PARAMETER = r"^(?::\w+\??|\{\w+\}|<(?:\w+:)?\w+>)$"
_UNSUPPORTED = r"[{}:*<>()\[\]?]"
_UUID_SEGMENT = r"(?i)^[\da-f]{8}-[\da-f]{4}-[\da-f]{4}-[\da-f]{4}-[\da-f]{12}$"


def segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def route_methods(routes: DataFrame) -> DataFrame:
    """One row per method a route answers: ANY covers all, GET also HEAD in frameworks that add it."""
    method = F.col("method")
    answers = (
        F.when(method == "ANY", F.array(*[F.lit(m) for m in names.MAPPED_METHODS]))
        .when((method == "GET") & F.col("framework").isin(*names.HEAD_AS_GET_FRAMEWORKS), F.array(F.lit("GET"), F.lit("HEAD")))
        .otherwise(F.array(method))
    )
    return routes.withColumn("match_method", F.explode(answers))


def route_shapes(routes: DataFrame) -> DataFrame:
    """Route templates as equi-join keys.

    A shape is (open, length, mask): how many leading segments are compared, which of them are
    parameters, and whether more may follow. Optional tails give one variant per length.
    """
    tokens = F.col("tokens")
    is_catch_all = lambda t: t.rlike(_CATCH_ALL)
    is_parameter = lambda t: t.rlike(_PARAMETER)
    split = routes.withColumn("tokens", segments(F.col("path")))
    split = split.withColumn("catch_all", (F.size(tokens) > 0) & F.coalesce(is_catch_all(F.element_at(tokens, -1)), F.lit(False)))
    split = split.withColumn("core", F.when(F.col("catch_all"), F.slice(tokens, F.lit(1), F.size(tokens) - 1)).otherwise(tokens))
    core = F.col("core")
    supported = ~F.exists(core, lambda t: is_catch_all(t) | (~is_parameter(t) & t.rlike(_UNSUPPORTED)))
    # Length of the core without its run of trailing optional parameters.
    required = F.aggregate(
        core, F.struct(F.lit(0).alias("n"), F.lit(0).alias("kept")),
        lambda acc, t: F.struct(
            (acc["n"] + 1).alias("n"), F.when(t.endswith("?"), acc["kept"]).otherwise(acc["n"] + 1).alias("kept")
        ),
        lambda acc: acc["kept"],
    )
    optional_tail = F.element_at(tokens, -1).endswith("?")
    exact = F.when(
        ~F.col("catch_all") | optional_tail,
        F.transform(F.sequence(required, F.size(core)), lambda n: F.struct(F.lit(False).alias("open"), n.alias("length"))),
    ).otherwise(F.array().cast("array<struct<open:boolean,length:int>>"))
    followed = F.when(
        F.col("catch_all"), F.array(F.struct(F.lit(True).alias("open"), F.size(core).alias("length")))
    ).otherwise(F.array().cast("array<struct<open:boolean,length:int>>"))
    variants = split.where(supported).withColumn("v", F.explode(F.concat(exact, followed)))
    compared = F.slice(core, F.lit(1), F.col("v.length"))
    return variants.select(
        *routes.columns,
        F.col("v.open").alias("open"), F.col("v.length").alias("length"),
        F.array_join(F.transform(compared, lambda t: F.when(is_parameter(t), F.lit("1")).otherwise(F.lit("0"))), "").alias("mask"),
        F.array_join(F.transform(compared, lambda t: F.when(is_parameter(t), F.lit("*")).otherwise(t)), "/").alias("match_key"),
        compared.alias("compared"),
        F.size(F.filter(core, lambda t: ~is_parameter(t))).alias("literal_count"),
        (F.size(F.filter(core, is_parameter)) + F.when(F.col("catch_all"), F.lit(1)).otherwise(F.lit(0))).alias("parameters"),
        F.col("catch_all").alias("uncertain"),
    )


def _violates_type(token: Column, value: Column) -> Column:
    return (token.startswith("<int:") & ~value.rlike(r"^\d+$")) | (token.startswith("<uuid:") & ~value.rlike(_UUID_SEGMENT))


def match_routes(endpoint_rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Endpoint/route pairs that match. ``routes``: route_id, ord, method, path, framework, file, line.

    Both joins are equi-joins: endpoints meet the distinct shapes of their length, are reduced to
    that shape's key, and then meet only the routes with the same key. Route tables of the usual size
    are broadcast after a count; larger ones are shuffled on the same keys.
    """
    shaped = route_methods(route_shapes(routes))
    shapes = shaped.select("open", "length", "mask").distinct()
    observed = segments(F.col("effective_path"))
    lengths = F.concat(
        F.array(F.struct(F.lit(False).alias("open"), F.size(observed).alias("length"))),
        F.transform(
            F.filter(F.sequence(F.lit(0), F.size(observed)), lambda n: n < F.size(observed)),
            lambda n: F.struct(F.lit(True).alias("open"), n.alias("length")),
        ),
    )
    reach = endpoint_rows.select("endpoint_id", "method", observed.alias("observed"), F.explode(lengths).alias("l")).select(
        "endpoint_id", F.col("method").alias("match_method"), "observed", F.col("l.open").alias("open"), F.col("l.length").alias("length")
    )
    keyed = reach.join(ordering.broadcast_if_small(shapes), ["open", "length"]).withColumn(
        "match_key",
        F.array_join(
            F.transform(
                F.slice("observed", F.lit(1), F.col("length")),
                lambda s, i: F.when(F.substr("mask", i + 1, F.lit(1)) == "1", F.lit("*")).otherwise(s),
            ),
            "/",
        ),
    )
    route_side = shaped.select(
        "match_method", "open", "length", "mask", "match_key", "compared", "route_id", "ord",
        F.col("method").alias("route_method"), F.col("path").alias("route_path"), "framework", "file", "line",
        "literal_count", "parameters", "uncertain",
    )
    pairs = keyed.join(ordering.broadcast_if_small(route_side), ["match_method", "open", "length", "mask", "match_key"])
    typed = F.exists(F.zip_with("compared", F.slice("observed", F.lit(1), F.col("length")), _violates_type), lambda bad: bad)
    return pairs.where(~typed).select(
        "endpoint_id", "route_id", "ord", "route_method", "route_path", "framework", "file", "line",
        "literal_count", "parameters", "uncertain",
    )


def mapping_states(endpoint_rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Every endpoint with its match count and state: unmapped, candidate or ambiguous."""
    counted = matches.groupBy("endpoint_id").agg(F.count(F.lit(1)).alias("match_count"))
    count = F.coalesce("match_count", F.lit(0))
    state = F.when(count == 0, F.lit("unmapped")).when(count == 1, F.lit("candidate")).otherwise(F.lit("ambiguous"))
    return endpoint_rows.join(counted, "endpoint_id", "left").withColumns({"match_count": count, "state": state})


def unobserved_routes(routes: DataFrame, matches: DataFrame) -> DataFrame:
    return routes.join(matches.select("route_id").distinct(), "route_id", "left_anti")


def state_counts(states: DataFrame, unobserved: DataFrame) -> DataFrame:
    """Endpoints per state and the number of routes never observed."""
    return (
        states.groupBy("state")
        .agg(F.count(F.lit(1)).alias("n"))
        .unionByName(unobserved.agg(F.count(F.lit(1)).alias("n")).withColumn("state", F.lit("unobserved_route")))
    )


def ranked_candidates(matches: DataFrame, limit: int = 30) -> DataFrame:
    """The ``limit`` best matches of each endpoint, ranked by literals, file and line among all of its matches."""
    order = [F.desc("literal_count"), F.col("file"), F.col("line"), F.col("ord")]
    return ordering.smallest_per_group(matches, ["endpoint_id"], order, limit)


# -- router mounts -----------------------------------------------------------
def join_route(a: Column, b: Column) -> Column:
    text = F.regexp_replace(F.concat(F.lit("/"), a, F.lit("/"), b), r"/{2,}", "/")
    return tx.or_else(F.regexp_replace(text, r"/$", ""), "/")


TRAIL = "array<struct<file:string,line:int>>"


def mount_prefixes(
    nodes: DataFrame, mounts: DataFrame, max_depth: int | None = None, max_length: int | None = None, max_chains: int | None = None
) -> DataFrame:
    """``(node_id, full_prefix, depth, trail)`` of every router reachable from an application root, one row per mount chain.

    ``nodes``: node_id, is_root, prefix; ``mounts``: child, parent, prefix, override and, for the ``trail`` of (file, line) of
    the chain's mounts from the root down, file and line. A null prefix is not resolvable, cycles are cut, an
    overriding mount replaces the child's own prefix. Chains beyond ``max_depth`` mounts, prefixes beyond ``max_length``
    characters and chains of a router beyond its first ``max_chains`` by prefix and trail are left out only where a caller sets these.

    One join per level; each level is a table below the shared root, so any number of rows and levels goes through
    and a lost executor costs one level.
    """
    spark = nodes.sparkSession
    placed = {"file", "line"} <= set(mounts.columns)
    mount = F.array(F.struct("file", F.col("line").cast("int").alias("line"))) if placed else F.array()
    children = (
        mounts.where(F.col("prefix").isNotNull())
        .select(F.col("child").alias("node_id"), "parent", F.col("prefix").alias("_mount"), "override", mount.cast(TRAIL).alias("_place"))
        .join(nodes.where(~F.col("is_root") & F.col("prefix").isNotNull()).select("node_id", F.col("prefix").alias("_own")), "node_id")
    )
    step = F.concat_ws("/", "_above", "_mount", F.when(F.col("override"), F.lit("")).otherwise(F.col("_own")))
    level = nodes.where(F.col("is_root") & F.col("prefix").isNotNull()).select(
        "node_id", F.col("prefix").alias("full_prefix"), F.lit(0).alias("depth"), F.array().cast(TRAIL).alias("trail"), F.array("node_id").alias("_chain")
    )
    levels: list[str] = []
    while True:
        path = scratch(spark, "mounts")
        level.write.parquet(path)
        current = spark.read.schema(level.schema).parquet(path)
        if current.isEmpty() and levels:
            break
        levels.append(path)
        if max_depth is not None and len(levels) > max_depth:
            break
        above = current.select(F.col("node_id").alias("parent"), F.col("full_prefix").alias("_above"), "depth", "trail", "_chain")
        found = children.join(above, "parent").where(~F.array_contains("_chain", F.col("node_id")))
        level = found.select(
            "node_id", join_route(step, F.lit("")).alias("full_prefix"), (F.col("depth") + 1).alias("depth"),
            F.concat("trail", "_place").alias("trail"), F.array_append("_chain", F.col("node_id")).alias("_chain"),
        )
        if max_length is not None:
            level = level.where(F.length("full_prefix") <= max_length)
        if max_chains is not None:
            level = ordering.smallest_per_group(level, ["node_id"], [F.col("full_prefix"), F.col("trail"), F.col("_chain")], max_chains).drop("rank")
    return spark.read.schema(level.schema).parquet(*levels).drop("_chain")


def compose_routes(routes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Routes declared on routers, with every resolved prefix applied and its trail as ``mounts``; unresolved routers give no row."""
    resolved = ordering.lookup_join(routes, prefixes, ["node_id"], ["path"])
    return resolved.withColumn("path", join_route(F.col("full_prefix"), F.col("path"))).withColumnRenamed("trail", "mounts")

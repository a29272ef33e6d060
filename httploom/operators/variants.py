"""Offline request-variant tables for manual review: nothing here sends a request.

Points of variation are arrays computed per finding; the values are the user's. The shipped default
holds boundary numbers and a marker word only.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http, jsonx, names, urls
from ..functions import text as tx
from ..session import stored
from . import ordering

MARKER = "review-marker"
REVIEW_TARGET = "https://example.invalid/"
DEFAULT_VALUES = {
    "IDOR": [("zero", "0"), ("one", "1"), ("negative", "-1")],
    "Reflected Input (XSS candidate)": [("marker", MARKER)],
    "Open Redirect": [("external", REVIEW_TARGET)],
}
POINT = "struct<type:string,param_name:string,original_value:string,position:int>"
POINT_COLUMNS = {
    "type": "injection_type", "param_name": "injection_point", "original_value": "original_value", "position": "position",
}


# -- finding -> item ---------------------------------------------------------
def _item_struct() -> Column:
    return F.struct("index", "slug", "method", "url", "path", "request_headers", "request_body")


def items_by_slug(findings: DataFrame, items: DataFrame) -> DataFrame:
    """Attach the item named first in each finding; null where there is none.

    Findings that name no item skip the join, so they cannot pile up on its null key.
    """
    lookup = items.select(F.col("slug").alias("source_slug"), _item_struct().alias("item"))
    named = findings.withColumn("source_slug", F.get("items", F.lit(0)))
    joined = named.where(F.col("source_slug").isNotNull()).join(lookup, "source_slug", "left")
    nameless = named.where(F.col("source_slug").isNull())
    return joined.unionByName(nameless.withColumn("item", F.lit(None).cast(joined.schema["item"].dataType)))


def first_endpoint_in_title(findings: DataFrame, items: DataFrame) -> DataFrame:
    """For each finding: index of the first item of its host whose ``METHOD path`` occurs in the title.

    Containment becomes an equi-join: at each blank of the title that follows one of the host's methods, the texts of
    the lengths that the host's endpoints of that method have are looked up among them.
    """
    known = (
        items.where(~F.col("method").contains(" "))
        .groupBy("host", "method", http.endpoint(F.col("method"), F.col("path")).alias("endpoint"))
        .agg(F.min("index").alias("index"))
    )
    # At most methods x path lengths structs a host.
    shapes = known.groupBy("host").agg(F.collect_set(F.struct("method", F.length("endpoint").alias("size"))).alias("_shapes"))
    titled = ordering.lookup_join(findings.select("finding_id", "host", "title"), shapes, ["host"], ["finding_id"])
    title = F.col("title")
    blanks = F.filter(F.sequence(F.lit(1), F.greatest(F.length(title), F.lit(1))), lambda p: F.substr(title, p, F.lit(1)) == " ")

    def texts(blank: Column) -> Column:
        def text(shape: Column) -> Column:
            start = blank - F.length(shape["method"])
            fits = (start >= 1) & (start + shape["size"] - 1 <= F.length(title))
            here = F.substr(title, start, F.length(shape["method"])) == shape["method"]
            return F.when(fits & here, F.substr(title, start, shape["size"]))

        return F.array_compact(F.transform("_shapes", text))

    candidates = titled.select(
        "finding_id", "host", F.explode(F.array_distinct(F.flatten(F.transform(blanks, texts)))).alias("endpoint")
    )
    by_text = known.groupBy("host", "endpoint").agg(F.min("index").alias("index"))
    found = ordering.lookup_join(candidates, by_text, ["host", "endpoint"], ["finding_id"])
    return found.groupBy("finding_id").agg(F.min("index").alias("index"))


def first_get_item(findings: DataFrame, items: DataFrame) -> DataFrame:
    """For each finding: index of the first GET item of its host."""
    firsts = items.where(F.col("method") == "GET").groupBy("host").agg(F.min("index").alias("index"))
    found = ordering.lookup_join(findings.select("finding_id", "host"), firsts, ["host"], ["finding_id"])
    return found.select("finding_id", "index")


def with_source_items(findings: DataFrame, items: DataFrame, fallback: str = "title") -> DataFrame:
    """Findings with their item: by slug, else by the endpoint in the title (or the host's first GET item).

    Which findings need the fallback is settled on slugs alone; wide items are joined once.
    """
    named = findings.withColumn("source_slug", F.get("items", F.lit(0)))
    if fallback == "get":  # only findings that name no item at all
        missing = named.where(F.col("source_slug").isNull())
        chosen = first_get_item(missing, items)
    else:
        missing = named.join(items.select(F.col("slug").alias("source_slug")), "source_slug", "left_anti")
        chosen = first_endpoint_in_title(missing, items)
    resolved = items_by_slug(findings, items).where(F.col("item").isNotNull())
    wide = items.select("index", _item_struct().alias("item"))
    found = chosen.join(wide, "index").select("finding_id", "item")
    return resolved.unionByName(missing.join(found, "finding_id"))


# -- points of variation -----------------------------------------------------
def _points(values: Column, kind: str, name, original, position=None) -> Column:
    return F.transform(
        values,
        lambda v: F.struct(
            F.lit(kind).alias("type"), name(v).alias("param_name"), original(v).alias("original_value"),
            (F.lit(0) if position is None else position(v)).cast("int").alias("position"),
        ),
    )


def points() -> Column:
    """Variation points of a row with ``item``, ``category`` and ``detail`` as ``array<POINT>``."""
    none = F.array().cast(f"array<{POINT}>")
    pairs = urls.query_pairs(urls.query(F.col("item.url")))
    as_query = lambda chosen: _points(chosen, "query_param", lambda p: p["name"], lambda p: p["value"])

    numbered = F.transform(F.split("item.path", "/"), lambda s, i: F.struct(s.alias("segment"), i.alias("i")))
    in_path = _points(
        F.filter(numbered, lambda s: s["segment"].rlike(r"^\d{1,10}$")), "path_segment",
        lambda s: F.concat(F.lit("path["), s["i"].cast("string"), F.lit("]")), lambda s: s["segment"], lambda s: s["i"],
    )
    in_query = as_query(F.filter(pairs, lambda p: F.lower(p["name"]).isin(*names.VARIATION_QUERY_IDS)))
    in_json = _points(
        F.filter(
            F.coalesce(jsonx.entries(F.col("item.request_body")), F.array().cast("array<struct<key:string,kind:string,value:string>>")),
            lambda e: F.lower(e["key"]).isin(*names.VARIATION_JSON_IDS) & jsonx.is_int_or_text(e["kind"]),
        ),
        "json_body", lambda e: e["key"], lambda e: e["value"],
    )
    named = F.regexp_extract("detail", r"[Pp]aram '(\w+)'", 1)
    by_name = as_query(F.slice(F.filter(pairs, lambda p: p["name"] == named), 1, 1))
    category = F.col("category")
    specific = (
        F.when(category == "IDOR", F.concat(in_path, in_query, in_json))
        .when(category.contains("Reflected") | category.contains("XSS") | (category == "Open Redirect"), by_name)
        .otherwise(none)
    )
    return F.when(F.size(specific) > 0, specific).otherwise(as_query(pairs))


def with_points(sourced: DataFrame) -> DataFrame:
    """Explode the points; a parameter named twice in one finding keeps its first point."""
    found = sourced.withColumn("_points", points())
    first_only = F.filter(
        F.transform("_points", lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        lambda x: x["i"] == F.array_position(F.transform("_points", lambda q: q["param_name"]), x["p"]["param_name"]) - 1,
    )
    return found.withColumn("_first", first_only).select(*sourced.columns, F.explode("_first").alias("_x")).select(
        *sourced.columns,
        *[F.col(f"_x.p.{old}").alias(new) for old, new in POINT_COLUMNS.items()],
        F.col("_x.i").alias("point_order"),
    )


# -- substitution ------------------------------------------------------------
def url_pieces(url: Column, point: Column) -> Column:
    """What stands before and after the value of a path or query point, and whether it is form-coded; for other points the whole URL."""

    def pieces(before: Column, after: Column, coded: bool) -> Column:
        return F.struct(before.alias("before"), after.alias("after"), F.lit(coded).alias("coded"))

    nothing, end = F.lit(None).cast("string"), urls.fragment_suffix(url)
    start = F.concat(urls.prefix(url), urls.path(url))

    def in_path(parts: Column) -> Column:
        at = point["position"]
        first, rest = F.slice(parts, F.lit(1), at), F.slice(parts, at + 2, F.size(parts))
        own_query = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
        before = F.concat(urls.prefix(url), F.array_join(F.transform(first, lambda s: F.concat(s, F.lit("/"))), ""))
        after = F.concat(F.array_join(F.transform(rest, lambda s: F.concat(F.lit("/"), s)), ""), own_query, end)
        return F.when((at >= 0) & (at < F.size(parts)), pieces(before, after, False)).otherwise(pieces(F.concat(start, own_query, end), nothing, False))

    def in_query(pairs: Column) -> Column:
        def around(at: Column) -> Column:
            first = F.when(at > 0, F.slice(pairs, F.lit(1), F.greatest(at - 1, F.lit(0)))).otherwise(pairs)
            rest = F.when(at > 0, F.slice(pairs, at + 1, F.size(pairs))).otherwise(F.slice(pairs, F.lit(1), F.lit(0)))
            coded = lambda p: F.concat(urls.encode(p["name"]), F.lit("="), urls.encode(p["value"]))
            before = F.array_join(F.transform(first, lambda p: F.concat(coded(p), F.lit("&"))), "")
            after = F.array_join(F.transform(rest, lambda p: F.concat(F.lit("&"), coded(p))), "")
            return pieces(F.concat(start, F.lit("?"), before, urls.encode(point["param_name"]), F.lit("=")), F.concat(after, end), True)

        return tx.let(F.array_position(F.transform(pairs, lambda p: p["name"]), point["param_name"]).cast("int"), around)

    return (
        F.when(point["type"] == "path_segment", tx.let(F.split(urls.path(url), "/"), in_path))
        .when(point["type"] == "query_param", tx.let(urls.query_pairs(urls.query(url), keep_blank=True), in_query))
        .otherwise(pieces(url, nothing, False))
    )


def joined_url(pieces: Column, value: Column) -> Column:
    placed = F.when(pieces["coded"], urls.encode(value)).otherwise(value)
    return F.when(pieces["after"].isNull(), pieces["before"]).otherwise(F.concat(pieces["before"], placed, pieces["after"]))


def substituted_url(url: Column, point: Column, value: Column) -> Column:
    """URL with the value put at a path or query point; other points leave it unchanged."""
    return tx.let(url_pieces(url, point), lambda pieces: joined_url(pieces, value))


def sendable_headers(headers: Column) -> Column:
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin("content-length", "transfer-encoding"))


def substituted_request(rows: DataFrame, value: str = "value") -> DataFrame:
    """Add ``request`` (method, url, headers, body) with the value put at the row's point, whose URL is cut in ``pieces``."""
    is_json = F.col("injection_type") == "json_body"
    new_body = F.when(
        is_json, jsonx.substitute(F.col("item.request_body"), F.col("injection_point"), F.col(value), is_json)
    ).otherwise(F.col("item.request_body"))
    return rows.withColumn(
        "request",
        F.struct(
            tx.or_else(F.col("item.method"), "GET").alias("method"),
            joined_url(F.col("pieces"), F.col(value)).alias("url"),
            F.col("sendable").alias("headers"),
            new_body.alias("body"),
        ),
    )


# -- manifest ----------------------------------------------------------------
NEIGHBOURS = ["prev_id", "next_id"]


def checked_values(values: dict[str, list[tuple[str, str]]] | None = None) -> dict[str, list[tuple[str, str]]]:
    """The user's category -> (label, value) mapping, or the benign default; labels must be unique."""
    chosen = DEFAULT_VALUES if values is None else values
    for pairs in chosen.values():
        labels = [label for label, _ in pairs]
        if len(set(labels)) < len(labels) or set(labels) & set(NEIGHBOURS):
            raise ValueError(f"Labels must be unique per category and differ from {NEIGHBOURS}")
    return chosen


def values_of(category: Column, values: dict[str, list[tuple[str, str]]] | None = None) -> Column:
    """Label/value structs of a category, empty for a category without values.

    The mapping is a short literal, so findings meet their values without a join: one category may
    hold most findings.
    """
    out = F.lit(None)
    for name, pairs in checked_values(values).items():
        rows = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(value).alias("value")) for label, value in pairs])
        out = F.when(category == name, rows).otherwise(out)
    return F.coalesce(out.cast("array<struct<label:string,value:string>>"), F.array().cast("array<struct<label:string,value:string>>"))


def _plain_digits(digits: Column) -> Column:
    return F.regexp_replace(digits, r"^0+(?=[0-9])", "")


def number_after(digits: Column) -> Column:
    """The next whole number, on digit text of any length."""

    def after(d: Column) -> Column:
        nines = F.regexp_extract(d, r"(9*)$", 1)
        kept = F.substring(d, F.lit(1), F.length(d) - F.length(nines))
        raised = (F.coalesce(F.nullif(F.right(kept, F.lit(1)), F.lit("")), F.lit("0")).cast("int") + 1).cast("string")
        return F.concat(F.substring(kept, F.lit(1), F.length(kept) - 1), raised, F.repeat(F.lit("0"), F.length(nines)))

    return tx.let(_plain_digits(digits), after)


def number_before(digits: Column) -> Column:
    """The whole number before, on digit text of any length; -1 before 0."""

    def before(d: Column) -> Column:
        zeros = F.regexp_extract(d, r"(0*)$", 1)
        kept = F.substring(d, F.lit(1), F.length(d) - F.length(zeros))
        lowered = (F.right(kept, F.lit(1)).cast("int") - 1).cast("string")
        joined = F.concat(F.substring(kept, F.lit(1), F.length(kept) - 1), lowered, F.repeat(F.lit("9"), F.length(zeros)))
        return F.when(d == "0", F.lit("-1")).otherwise(_plain_digits(joined))

    return tx.let(_plain_digits(digits), before)


def manifest(findings: DataFrame, items: DataFrame, values: dict[str, list[tuple[str, str]]] | None = None) -> DataFrame:
    """One row per finding, point and value; numeric ids also get their neighbours. Case ids are unique.

    ``findings`` need a unique ``finding_id``; they are stored, because several joins read them. After the item lookup every
    step is row-local.
    """
    wanted = stored(findings.where(F.col("category").isin(*checked_values(values))), "findings")
    point = F.struct(*[F.col(new).alias(old) for old, new in POINT_COLUMNS.items()])
    # What does not depend on the value is made once per point.
    own = {"pieces": tx.let(point, lambda p: url_pieces(F.col("item.url"), p)), "sendable": sendable_headers(F.col("item.request_headers"))}
    pointed = with_points(with_source_items(wanted, items)).withColumns(own)
    original = F.col("original_value")
    numeric = (F.col("category") == "IDOR") & original.rlike(r"^[0-9]+$")
    beside = F.array(
        *[
            F.struct(F.lit(label).alias("label"), changed.alias("value"))
            for label, changed in zip(NEIGHBOURS, (number_before(original), number_after(original)))
        ]
    )
    given = values_of(F.col("category"), values)
    chosen = F.when(numeric, F.concat(given, beside)).otherwise(given)
    cases = pointed.select(*pointed.columns, F.explode(chosen).alias("_case")).select(*pointed.columns, "_case.label", "_case.value")
    case_id = F.concat_ws("_", F.lit("case"), F.col("finding_id").cast("string"), "injection_point", "label")
    return substituted_request(cases).select(
        case_id.alias("case_id"), "finding_id", "title", "category", "severity", "injection_point", "injection_type",
        "original_value", "label", "value", "request",
    )


def manifest_summary(findings: DataFrame, cases: DataFrame) -> DataFrame:
    """Findings analysed, cases, and the categories covered."""
    totals = cases.groupBy("category").agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("cases"), F.array_join(F.array_sort(F.collect_list("category")), ", ").alias("categories")
    )
    return totals.withColumn("findings", findings.agg(F.count(F.lit(1)).alias("n")).scalar())


# -- review templates --------------------------------------------------------
def _matcher(kind: str, part: str, values: list[str]) -> str:
    return json.dumps({"type": kind, "part": part, "words" if kind == "word" else kind: values})


# What a reviewer's template looks for, per category.
MATCHERS = {
    "Information Disclosure": [
        _matcher("regex", "body", [r"(?i)(SQL syntax|Traceback \(most recent call last\)|stack\s*trace|Unhandled Exception)"])
    ],
    "Sensitive Data Exposure": [_matcher("regex", "body", [r"gh[pousr]_[a-zA-Z0-9]{36}|AKIA[A-Z0-9]{16}"])],
    "Open Redirect": [_matcher("regex", "header", [r"(?im)^location:\s*https://example\.invalid/"])],
    "Reflected Input (XSS candidate)": [_matcher("word", "body", [MARKER])],
    "CORS Misconfiguration": [
        _matcher("regex", "header", [r"(?im)^access-control-allow-origin:\s*https://example\.invalid\s*$"]),
        _matcher("regex", "header", [r"(?im)^access-control-allow-credentials:\s*true\s*$"]),
    ],
    "Cookie Security": [
        _matcher(
            "dsl", "header",
            ["contains(tolower(all_headers), 'set-cookie:') && (!contains(tolower(all_headers), 'httponly') || !contains(tolower(all_headers), 'secure'))"],
        )
    ],
    "IDOR": [_matcher("dsl", "body", ["status_code_1 == 200 && status_code_2 == 200 && body_1 != body_2"])],
}
# Request headers that a category's template adds.
TEMPLATE_HEADERS = {"CORS Misconfiguration": [("Origin", REVIEW_TARGET.rstrip("/"))]}


def review_templates(findings: DataFrame, items: DataFrame) -> DataFrame:
    """One review template per eligible GET finding: targets, added request headers, matchers, severity fixed to ``info``.

    Targets hold the captured path and, where the category varies a value, the changed path.
    """
    sourced = with_source_items(findings, items, fallback="get").where(F.upper("item.method") == "GET")
    category = F.col("category")
    usable = sourced.where(category.isin(*MATCHERS, "Security Headers")).withColumn("_points", points())
    in_url = F.filter("_points", lambda p: p["type"].isin("path_segment", "query_param"))
    varies = category.isin("IDOR", "Reflected Input (XSS candidate)", "Open Redirect")
    pointed = usable.withColumn("point", F.when(varies, F.get(in_url, F.lit(0)))).where(~varies | F.col("point").isNotNull())
    pointed = pointed.where((category != "IDOR") | F.col("point.original_value").rlike(r"^[0-9]+$"))
    following = F.when(category == "IDOR", number_after(F.col("point.original_value")))
    value = F.when(category == "IDOR", following).when(category == "Open Redirect", F.lit(REVIEW_TARGET)).otherwise(F.lit(MARKER))

    def target(url: Column) -> Column:
        return F.concat(tx.or_else(urls.path(url), "/"), urls.question(urls.query(url)))

    changed = target(substituted_url(F.col("item.url"), F.col("point"), value))
    own = target(F.col("item.url"))
    targets = F.when(category == "IDOR", F.array(own, changed)).when(varies, F.array(changed)).otherwise(F.array(own))
    missing = F.filter(F.split(tx.after(F.col("detail"), ": "), ", "), lambda h: h.rlike("^[a-z-]+$"))
    header_matchers = F.transform(
        missing, lambda h: F.concat(F.lit('{"type": "word", "part": "header", "words": ["'), h, F.lit(':"], "negative": true, "case-insensitive": true}'))
    )
    matchers = F.when(category == "Security Headers", header_matchers)
    for name, fixed in MATCHERS.items():
        matchers = matchers.when(category == name, F.array(*[F.lit(m) for m in fixed]))
    headers = F.array().cast("array<struct<name:string,value:string>>")
    for name, added in TEMPLATE_HEADERS.items():
        given = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in added])
        headers = F.when(category == name, given).otherwise(headers)
    shaped = pointed.select(
        "finding_id", "category", F.concat("title", F.lit(" (review candidate)")).alias("name"), F.lit("info").alias("severity"),
        F.col("item.slug").alias("source_item"), "host", targets.alias("targets"), headers.alias("request_headers"), matchers.alias("matchers"),
        F.when(category.isin("Security Headers"), F.lit("or")).otherwise(F.lit("and")).alias("matchers_condition"),
    )
    return shaped.where(F.size("matchers") > 0)

"""Passive review rules: items -> findings.

Row rules are column expressions yielding ``array<finding>``; ``all_findings`` evaluates them in
one pass over the items. Group rules aggregate bit masks, so a hot host or endpoint reduces to
one partial row per task. Every finding is a candidate for manual review.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http, jsonx, names, urls
from ..functions import text as tx
from ..schema import FINDING
from ..session import stored

COLUMNS = [field.name for field in FINDING.fields]
# Order of the rules in a report; findings sort by it within a severity.
RULE_ORDER = {
    "headers": 0, "ids": 1, "reflected": 2, "errors": 3, "sensitive": 4, "jwt": 5, "unauthenticated": 6,
    "cors": 7, "methods": 8, "cookies": 9, "redirects": 10, "api_secrets": 11,
}


def _endpoint() -> Column:
    return http.endpoint(F.col("method"), F.col("path"))


def _finding(rule: str, category: str, severity: str, title: Column, detail: Column) -> Column:
    return F.struct(
        F.lit(category).alias("category"), F.lit(severity).alias("severity"), title.alias("title"), detail.alias("detail"),
        F.col("host").alias("host"), F.array(F.col("slug")).alias("items"), F.lit(RULE_ORDER[rule]).alias("rule_order"),
        F.col("index").alias("ord"),
    )


def _at_most_one(condition: Column, finding: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(finding)).otherwise(F.array().cast(f"array<{FINDING.simpleString()}>"))


def _query(keep_blank: bool = False) -> Column:
    return urls.query_pairs(urls.query(F.col("url")), keep_blank)


# -- row rules ---------------------------------------------------------------
def id_suspects() -> Column:
    """``location=value`` texts for numeric or id-named inputs of an item."""
    body = F.col("request_body")
    is_id = lambda p: F.lower(p["name"]).isin(*names.ID_PARAMETERS)
    in_path = F.transform(F.regexp_extract_all("path", F.lit(names.NUMERIC_PATH_ID), 1), lambda v: F.concat(F.lit("path="), v))
    in_query = F.transform(
        F.filter(_query(), is_id), lambda p: F.concat(F.lit("param:"), p["name"], F.lit("="), p["value"])
    )
    in_json = F.transform(
        F.filter(
            jsonx.entries(body), lambda e: F.lower(e["key"]).isin(*names.ID_PARAMETERS) & jsonx.is_int_or_text(e["kind"])
        ),
        lambda e: F.concat(F.lit("json:"), e["key"], F.lit("="), e["value"]),
    )
    in_form = F.when(
        (body != "") & ~jsonx.is_valid(body),
        F.transform(
            F.filter(urls.query_pairs(body), is_id), lambda p: F.concat(F.lit("body:"), p["name"], F.lit("="), p["value"])
        ),
    )
    none = F.array().cast("array<string>")
    return F.concat(in_path, in_query, F.coalesce(in_json, none), F.coalesce(in_form, none))


def id_rule() -> Column:
    return tx.let(
        id_suspects(),
        lambda suspects: _at_most_one(
            F.size(suspects) > 0,
            _finding(
                "ids", "IDOR", "High", F.concat(F.lit("Potential IDOR: "), _endpoint()),
                F.concat(F.lit("Numeric/predictable identifiers: "), F.array_join(suspects, ", ")),
            ),
        ),
    )


def reflected_rule() -> Column:
    long_values = F.filter(
        F.when(F.col("response_body") != "", _query()), lambda p: F.length(p["value"]) >= 4
    )
    # The body is lower-cased once, and only for requests with a value worth searching for.
    hits = F.when(
        F.size(long_values) > 0,
        tx.let(
            F.lower("response_body"),
            lambda content: F.filter(long_values, lambda p: F.contains(content, F.lower(p["value"]))),
        ),
    )
    return tx.let(
        F.get(hits, F.lit(0)),
        lambda hit: _at_most_one(
            hit.isNotNull(),
            _finding(
                "reflected", "Reflected Input (XSS candidate)", "High",
                F.concat(F.lit("Reflected param '"), hit["name"], F.lit("' in response: "), _endpoint()),
                F.concat(
                    F.lit("Value '"), F.substring(hit["value"], 1, 60), F.lit("' from query param '"), hit["name"],
                    F.lit("' appears in response body."),
                ),
            ),
        ),
    )


def error_rule() -> Column:
    content = F.when(F.col("response_body") != "", F.col("response_body")).otherwise(F.col("response_raw"))
    return tx.let(
        tx.first_label(content, names.ERROR_PATTERNS),
        lambda label: _at_most_one(
            label.isNotNull(),
            _finding(
                "errors", "Information Disclosure", "Medium",
                F.concat(label, F.lit(": "), _endpoint(), F.lit(" ["), F.col("status"), F.lit("]")),
                F.concat(F.lit("Response contains "), F.lower(label), F.lit(" pattern.")),
            ),
        ),
    )


def sensitive_rule() -> Column:
    content = F.col("response_body")
    (email, email_label), *others = names.SENSITIVE_PATTERNS
    # The literal '@' test spares most bodies the costly address scan.
    label = F.when(content.contains("@") & content.rlike(email), F.lit(email_label)).otherwise(
        tx.first_label(content, others)
    )
    return tx.let(
        label,
        lambda found: _at_most_one(
            found.isNotNull(),
            _finding(
                "sensitive", "Sensitive Data Exposure", "High", F.concat(found, F.lit(" in response: "), _endpoint()),
                F.lit(f"Matched pattern: '{names.MASK}...'"),
            ),
        ),
    )


def decode_token_part(part: Column) -> Column:
    """base64url JSON segment as variant, null when it does not decode."""
    standard = F.translate(part, "-_", "+/")
    padded = F.concat(standard, F.repeat(F.lit("="), F.pmod(4 - F.pmod(F.length(standard), F.lit(4)), F.lit(4)).cast("int")))
    return F.try_parse_json(F.try_validate_utf8(F.try_to_binary(padded, F.lit("base64")).cast("string")))


def token_issues(token: Column) -> Column:
    """Review notes for one JWT: unsigned algorithm, sensitive claim names. Empty when none."""

    def notes_on(parts: Column) -> Column:
        header, payload = parts["header"], parts["payload"]
        unsigned = F.lower(F.coalesce(F.try_variant_get(header, "$.alg", "string"), F.lit(""))) == "none"
        claims = F.array_compact(
            F.array(
                *[
                    F.when(F.try_variant_get(payload, f"$.{name}", "variant").isNotNull(), F.lit(f"'{name}'"))
                    for name in names.JWT_SENSITIVE_CLAIMS
                ]
            )
        )
        readable = F.schema_of_variant(header).startswith("OBJECT") & F.schema_of_variant(payload).startswith("OBJECT")
        notes = F.array(
            F.when(unsigned, F.lit("Algorithm set to 'none'")),
            F.when(F.size(claims) > 0, F.concat(F.lit("Sensitive claims: ["), F.array_join(claims, ", "), F.lit("]"))),
        )
        return F.when(F.coalesce(readable, F.lit(False)), F.array_join(notes, " | ")).otherwise(F.lit(""))

    parts = F.split(token, r"\.")
    return tx.let(
        F.struct(decode_token_part(parts[0]).alias("header"), decode_token_part(parts[1]).alias("payload")), notes_on
    )


def jwt_rule() -> Column:
    """At most one finding for the request and one for the response: the first token with notes."""

    def side(raw: str) -> Column:
        tokens = F.regexp_extract_all(raw, F.lit(names.JWT_PATTERN), 0)
        noted = F.filter(F.transform(F.when(F.col(raw).contains("eyJ"), tokens), token_issues), lambda n: n != "")
        return F.get(noted, F.lit(0))

    sides = F.array_compact(F.array(side("request_raw"), side("response_raw")))
    return F.transform(
        sides,
        lambda note: _finding("jwt", "JWT Security", "High", F.concat(F.lit("Insecure JWT found: "), _endpoint()), note),
    )


def unauthenticated_rule() -> Column:
    path = F.col("path")
    return _at_most_one(
        (F.size("request_headers") > 0)
        & ~http.has_any_header(F.col("request_headers"), names.AUTH_HEADERS)
        & F.col("status").startswith("2")
        & (path != "")
        & ~path.isin(*names.OPEN_PATHS),
        _finding(
            "unauthenticated", "Authentication", "Medium", F.concat(F.lit("Unauthenticated 2xx: "), _endpoint()),
            F.lit("Endpoint returned success without any auth headers in request."),
        ),
    )


def cors_rule() -> Column:
    headers = F.col("response_headers")
    origin_of = tx.strip(http.header_value(headers, "access-control-allow-origin"))
    credentials = F.lower(tx.strip(http.header_value(headers, "access-control-allow-credentials")))
    wildcard_note = (
        "Any origin can read noncredentialed responses. This may be intentional for public resources; "
        "browsers reject wildcard origins with credentials."
    )
    allowlist_note = (
        "'. Confirm whether it is trusted and sensitive data is exposed; a captured allowlist value does not "
        "prove arbitrary origin reflection."
    )

    def review(origin: Column) -> Column:
        wildcard = origin == "*"
        title = F.when(wildcard, F.lit("Wildcard CORS review: ")).otherwise(F.lit("Credentialed CORS review: "))
        detail = F.when(wildcard, F.lit(wildcard_note)).otherwise(
            F.concat(F.lit("Allowed origin '"), origin, F.lit(allowlist_note))
        )
        return _at_most_one(
            (origin != "") & (wildcard | (credentials == "true")),
            _finding("cors", "CORS Misconfiguration", "Info", F.concat(title, _endpoint()), detail),
        )

    return tx.let(origin_of, review)


def redirect_rule() -> Column:
    external = F.filter(
        _query(),
        lambda p: F.lower(p["name"]).isin(*names.REDIRECT_PARAMETERS)
        & (p["value"].startswith("http") | p["value"].startswith("//")),
    )
    return tx.let(
        F.get(external, F.lit(0)),
        lambda hit: _at_most_one(
            hit.isNotNull(),
            _finding(
                "redirects", "Open Redirect", "Medium", F.concat(F.lit("Open redirect candidate: "), _endpoint()),
                F.concat(
                    F.lit("Param '"), hit["name"], F.lit("' = '"), F.substring(hit["value"], 1, 80),
                    F.lit("' contains external URL."),
                ),
            ),
        ),
    )


def row_findings(items: DataFrame, *rules: Column) -> DataFrame:
    """Evaluate row rules in one scan."""
    together = rules[0] if len(rules) == 1 else F.concat(*rules)
    return items.select(F.explode(together).alias("f")).select("f.*")


# -- group rules -------------------------------------------------------------
def _mask_of(present, values: list[str]) -> Column:
    """Bit ``i`` set where ``present(values[i])`` holds."""
    return reduce(
        lambda a, b: a.bitwiseOR(b), [F.when(present(v), F.lit(1 << n)).otherwise(F.lit(0)) for n, v in enumerate(values)]
    )


def _names_in(mask: Column, values: list[str], wanted: int) -> Column:
    return F.array_compact(
        F.array(*[F.when(mask.bitwiseAND(F.lit(1 << n)) == (wanted << n), F.lit(v)) for n, v in enumerate(values)])
    )


def missing_security_headers(items: DataFrame) -> DataFrame:
    """Per host: security headers never seen, over hosts that sent any response header."""
    seen = http.header_names(F.col("response_headers"))
    per_host = (
        items.where(F.size("response_headers") > 0)
        .select(
            tx.or_else(F.col("host"), "unknown").alias("host"), "index",
            tx.let(seen, lambda held: _mask_of(lambda name: F.array_contains(held, name), names.SECURITY_HEADERS)).alias("mask"),
        )
        .groupBy("host")
        .agg(F.bit_or("mask").alias("mask"), F.min("index").alias("ord"))
    )
    return per_host.select(
        "host", "ord", F.array_join(_names_in(F.col("mask"), names.SECURITY_HEADERS, 0), ", ").alias("missing")
    ).where(F.col("missing") != "")


def state_changing_methods(items: DataFrame) -> DataFrame:
    """Per host and path: the state-changing methods observed."""
    method = F.upper("method")
    per_path = items.select(
        "host", "path", "index", _mask_of(lambda name: method == name, names.STATE_CHANGING).alias("mask")
    ).groupBy("host", "path").agg(F.bit_or("mask").alias("mask"), F.min("index").alias("ord"))
    return per_path.select(
        "host", "path", "ord", F.array_join(_names_in(F.col("mask"), names.STATE_CHANGING, 1), ", ").alias("methods")
    ).where(F.col("methods") != "")


def _grouped(rule: str, df: DataFrame, category: str, severity: str, title: Column, detail: Column, items: Column) -> DataFrame:
    return df.select(
        F.lit(category).alias("category"), F.lit(severity).alias("severity"), title.alias("title"), detail.alias("detail"),
        F.col("host"), items.alias("items"), F.lit(RULE_ORDER[rule]).alias("rule_order"), F.col("ord"),
    )


def header_findings(items: DataFrame) -> DataFrame:
    return _grouped(
        "headers", missing_security_headers(items), "Security Headers", "Medium",
        F.concat(F.lit("Missing security headers on "), F.col("host")),
        F.concat(F.lit("Headers never observed: "), F.col("missing")),
        F.array().cast("array<string>"),
    )


def method_findings(items: DataFrame) -> DataFrame:
    return _grouped(
        "methods", state_changing_methods(items), "HTTP Methods", "Low",
        F.concat(F.lit("State-changing methods on "), F.col("path")),
        F.concat(F.lit("Methods observed: "), F.col("methods"), F.lit(". Verify authorization checks.")),
        F.array().cast("array<string>"),
    )


def cookie_issues(items: DataFrame) -> DataFrame:
    """Distinct (host, cookie, missing flags) with the slug and index that showed it first."""
    cookie = F.explode(http.set_cookies(F.col("response_headers"))).alias("cookie")
    labels = [("httponly", "HttpOnly"), ("secure", "Secure"), ("samesite", "SameSite")]
    missing = F.array_compact(
        F.array(*[F.when(~F.array_contains("cookie.flags", flag), F.lit(f"missing {label}")) for flag, label in labels])
    )
    return (
        items.select("host", "slug", "index", cookie)
        .select("host", "slug", "index", F.col("cookie.name").alias("name"), F.array_join(missing, ", ").alias("issues"))
        .where(F.col("issues") != "")
        .groupBy("host", "name", "issues")
        .agg(F.min_by("slug", "index").alias("slug"), F.min("index").alias("ord"))
    )


def cookie_findings(items: DataFrame) -> DataFrame:
    return _grouped(
        "cookies", cookie_issues(items), "Cookie Security", "Medium",
        F.concat(F.lit("Cookie review '"), F.col("name"), F.lit("' on "), F.col("host")),
        F.concat(F.lit("Cookie flags: "), F.col("issues"), F.lit(". Assess against the cookie purpose.")),
        F.array("slug"),
    )


def api_key_endpoints(items: DataFrame) -> DataFrame:
    """Host and ``METHOD path`` of every item with a key-shaped token in either body."""
    hit = F.col("request_body").rlike(names.API_KEY_PATTERN) | F.col("response_body").rlike(names.API_KEY_PATTERN)
    return items.where(hit).select("host", "index", _endpoint().alias("endpoint"))


def api_secret_findings(items: DataFrame) -> DataFrame:
    """One finding per host and endpoint, so that none is left out and no array grows with the traffic."""
    per_endpoint = api_key_endpoints(items).groupBy("host", "endpoint").agg(F.min("index").alias("ord"))
    return _grouped(
        "api_secrets", per_endpoint, "Sensitive Data", "High", F.lit("API Secrets Discovered"),
        F.lit("Potential API keys (GitHub, Slack, etc.) were found in the HTTP traffic."), F.array("endpoint"),
    )


ROW_RULES = {
    "ids": id_rule,
    "reflected": reflected_rule,
    "errors": error_rule,
    "sensitive": sensitive_rule,
    "jwt": jwt_rule,
    "unauthenticated": unauthenticated_rule,
    "cors": cors_rule,
    "redirects": redirect_rule,
}
GROUP_RULES = {
    "headers": header_findings,
    "methods": method_findings,
    "cookies": cookie_findings,
    "api_secrets": api_secret_findings,
}
DEFAULT_RULES = [*ROW_RULES, "headers", "methods", "cookies"]


def all_findings(items: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Union of the chosen rules; all row rules share one scan."""
    chosen = DEFAULT_RULES if rules is None else rules
    unknown = set(chosen) - set(ROW_RULES) - set(GROUP_RULES)
    if unknown:
        raise ValueError(f"Unknown rules: {sorted(unknown)}")
    parts = [GROUP_RULES[name](items) for name in chosen if name in GROUP_RULES]
    row_rules = [ROW_RULES[name]() for name in chosen if name in ROW_RULES]
    if row_rules:
        parts.insert(0, row_findings(items, *row_rules))
    return reduce(lambda a, b: a.unionByName(b), [part.select(*COLUMNS) for part in parts])


def severity_rank(severity: Column) -> Column:
    """Known severities in order, anything else with Info; case is ignored."""
    rank = F.array_position(F.array(*[F.lit(s.lower()) for s in names.SEVERITIES]), F.lower(severity))
    return F.when(rank == 0, F.lit(len(names.SEVERITIES))).otherwise(rank).cast("int") - 1


def sort_findings(findings: DataFrame) -> DataFrame:
    """Severity first, then rule and first appearance: a range-partitioned global sort.

    The sort reads its input twice, once for the ranges, so the findings are stored before.
    """
    return stored(findings, "findings").orderBy(severity_rank(F.col("severity")), "rule_order", "ord", "host", "title", "detail")


def count_by_severity(findings: DataFrame) -> DataFrame:
    """Counts per (severity, category), per severity and overall in one pass."""
    return findings.rollup("severity", "category").agg(F.count(F.lit(1)).alias("findings")).select(
        F.coalesce("severity", F.lit("all")).alias("severity"), F.coalesce("category", F.lit("all")).alias("category"), "findings"
    )

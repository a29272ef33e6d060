"""HTTP message normalisation as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import names, urls
from . import text as tx

CRLF2 = "\r\n\r\n"
LF2 = "\n\n"


# -- fields and messages -----------------------------------------------------
def is_bad_base64(raw: Column) -> Column:
    compact = F.regexp_replace(raw, r"\s", "")
    return ~compact.rlike(r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$")


def base64_bytes(raw: Column) -> Column:
    """Strictly decoded bytes; a malformed field fails the job."""
    compact = F.regexp_replace(raw, r"\s", "")
    return F.when(is_bad_base64(raw), F.raise_error(F.lit("Invalid base64 HTTP field")).cast("binary")).otherwise(
        F.unbase64(compact)
    )


def bytes_text(data: Column) -> Column:
    """UTF-8 text, or Latin-1 where the bytes are not valid UTF-8."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))


def decode_field(raw: Column, is_base64: Column) -> Column:
    return F.when(F.coalesce(raw, F.lit("")) == "", F.lit("")).when(is_base64, bytes_text(base64_bytes(raw))).otherwise(
        raw
    )


def head(raw: Column) -> Column:
    """Start line and headers; empty when the message has no blank line."""
    return (
        F.when(raw.contains(CRLF2), tx.before(raw, CRLF2))
        .when(raw.contains(LF2), tx.before(raw, LF2))
        .otherwise(F.lit(""))
    )


def body(raw: Column) -> Column:
    """Everything after the blank line; the whole text when there is none."""
    return F.when(raw.contains(CRLF2), tx.after(raw, CRLF2)).when(raw.contains(LF2), tx.after(raw, LF2)).otherwise(raw)


def first_line(raw: Column) -> Column:
    return tx.strip(F.when(raw.contains("\r\n"), tx.before(raw, "\r\n")).otherwise(tx.before(raw, "\n")))


def header_lines(raw: Column) -> Column:
    block = head(raw)
    lines = F.when(raw.contains(CRLF2), F.split(block, "\r\n")).otherwise(F.split(block, "\n"))
    return tail(lines)


def tail(values: Column) -> Column:
    """All elements but the first."""
    return F.filter(values, lambda _, i: i > 0)


def parse_headers(lines: Column) -> Column:
    """``Name: value`` lines to header structs, in order, lines without a colon dropped."""
    return F.transform(
        F.filter(lines, lambda line: line.contains(":")),
        lambda line: F.struct(
            tx.strip(tx.before(line, ":")).alias("name"), tx.strip(tx.after(line, ":")).alias("value")
        ),
    )


def merge_headers(headers: Column) -> Column:
    """One entry per case-insensitive name: first casing kept, values joined by a newline."""

    def merged(all_headers: Column) -> Column:
        def one(key: Column) -> Column:
            return tx.let(
                F.filter(all_headers, lambda h: F.lower(h["name"]) == key),
                lambda same: F.struct(
                    same[0]["name"].alias("name"),
                    F.array_join(F.transform(same, lambda h: h["value"]), "\n").alias("value"),
                ),
            )

        keys = F.transform(all_headers, lambda h: F.lower(h["name"]))
        # Repeated names are rare: without them the headers are already in their final form.
        return F.when(F.size(F.array_distinct(keys)) == F.size(all_headers), all_headers).otherwise(
            F.transform(F.array_distinct(keys), one)
        )

    return tx.let(headers, merged)


def headers_of(raw: Column) -> Column:
    return merge_headers(parse_headers(header_lines(raw)))


def rebuild(first: Column, headers: Column, content: Column) -> Column:
    """Raw message text from its parts; joined header values become separate lines again."""
    lines = F.flatten(
        F.transform(
            headers,
            lambda h: F.transform(F.split(h["value"], "\n"), lambda v: F.concat(h["name"], F.lit(": "), v, F.lit("\r\n"))),
        )
    )
    start = F.when(first == "", F.lit("")).otherwise(F.concat(first, F.lit("\r\n")))
    return F.concat(start, F.array_join(lines, ""), F.lit("\r\n"), content)


def status_code(status_line: Column) -> Column:
    parts = F.split(status_line, r"\s+", 3)
    return F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def request_method(line: Column) -> Column:
    return F.coalesce(F.get(F.split(line, r"\s+", 3), F.lit(0)), F.lit(""))


def request_target(line: Column) -> Column:
    return F.coalesce(F.get(F.split(line, r"\s+", 3), F.lit(1)), F.lit(""))


def target_path(target: Column) -> Column:
    return tx.or_else(urls.path(target), "/")


def extension(path: Column) -> Column:
    """Extension of the last path segment; hidden files and trailing dots have none."""
    return F.regexp_extract(path, r"(?:^|/)[^/]+\.([^./]+)$", 1)


def rebuild_url(protocol: Column, host: Column, port: Column, target: Column, path: Column) -> Column:
    """Absolute URL: default ports dropped, IPv6 hosts bracketed, absolute-form targets reduced."""
    default = ((protocol == "https") & (port == "443")) | ((protocol == "http") & (port == "80"))
    name = F.when(host.contains(":") & ~host.startswith("["), F.concat(F.lit("["), host, F.lit("]"))).otherwise(host)
    relative = F.when(target == "", tx.or_else(path, "/")).when(
        target.rlike("^https?://"),
        F.concat(
            urls.path(target),
            F.when(urls.query(target) == "", F.lit("")).otherwise(F.concat(F.lit("?"), urls.query(target))),
        ),
    ).otherwise(target)
    return F.when(host == "", F.lit("")).otherwise(
        F.concat(protocol, F.lit("://"), name, F.when(default, F.lit("")).otherwise(F.concat(F.lit(":"), port)), relative)
    )


# -- header access -----------------------------------------------------------
def header_names(headers: Column) -> Column:
    return F.transform(headers, lambda h: F.lower(h["name"]))


def header_value(headers: Column, name: str) -> Column:
    """Value of a header by lower-case name; empty when absent."""
    return F.coalesce(F.get(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(0))["value"], F.lit(""))


def has_any_header(headers: Column, wanted: list[str]) -> Column:
    return F.exists(headers, lambda h: F.lower(h["name"]).isin(*wanted))


def mime_type(headers: Column) -> Column:
    return tx.strip(tx.before(header_value(headers, "content-type"), ";"))


def cookie_pairs(headers: Column) -> Column:
    """Request cookies as name/value structs; parts without ``=`` are dropped."""
    parts = F.filter(F.split(header_value(headers, "cookie"), ";"), lambda p: p.contains("="))
    return F.transform(
        parts,
        lambda p: F.struct(tx.strip(tx.before(p, "=")).alias("name"), tx.strip(tx.after(p, "=")).alias("value")),
    )


def set_cookies(headers: Column) -> Column:
    """Response cookies as ``struct<name, flags>`` (flag names lower-case)."""
    lines = F.filter(F.split(header_value(headers, "set-cookie"), r"\r?\n"), lambda line: line != "")

    def one(line: Column) -> Column:
        fields = F.split(line, ";")
        flags = F.transform(tail(fields), lambda f: F.lower(tx.strip(tx.before(f, "="))))
        return F.struct(tx.strip(tx.before(fields[0], "=")).alias("name"), flags.alias("flags"))

    return F.transform(lines, one)


# -- labels ------------------------------------------------------------------
def normalise_tool(raw: Column) -> Column:
    """Numeric code, else the first alias contained in the text, else the text in lower case."""
    stripped = tx.strip(raw)
    lower = F.lower(stripped)
    out = F.when(F.coalesce(raw, F.lit("")) == "", F.lit("unknown"))
    for code, tool in names.TOOL_CODES.items():
        out = out.when(stripped == code, F.lit(tool))
    for alias, tool in names.TOOL_ALIASES.items():
        out = out.when(lower.contains(alias), F.lit(tool))
    return out.otherwise(tx.or_else(lower, "unknown"))


def infer_tool(comment: Column) -> Column:
    lower = F.lower(F.coalesce(comment, F.lit("")))
    return (
        F.when(lower.contains("repeater"), F.lit("repeater"))
        .when(lower.contains("intruder"), F.lit("intruder"))
        .when(lower.contains("scan"), F.lit("scanner"))
        .otherwise(F.lit("proxy"))
    )


def slug_number(index: Column) -> Column:
    """Beginning of a slug; with the ``_`` after it, it tells all slugs apart and orders them."""
    return F.lpad(index.cast("string"), F.greatest(F.length(index.cast("string")), F.lit(4)), F.lit("0"))


def slug(index: Column, method: Column, path: Column) -> Column:
    """``0001_METHOD_path`` with unsafe characters collapsed to ``_``."""
    verb = F.substring(F.regexp_replace(F.upper(tx.or_else(method, "REQ")), r"[^A-Z0-9_-]", "_"), 1, 10)
    part = F.regexp_replace(tx.or_else(path, "root"), r"(?U)[^\w\-.]", "_")
    part = F.substring(F.btrim(F.regexp_replace(part, r"_+", "_"), F.lit("_")), 1, 60)
    return F.concat(
        slug_number(index), F.lit("_"), verb, F.lit("_"), tx.or_else(part, "root"),
    )


def portable_segment(value: Column) -> Column:
    """Reserved device names get a ``_`` prefix; names over 64 characters keep 48 plus a hash tail."""

    def shortened(v: Column) -> Column:
        tail = F.substring(F.sha2(v.cast("binary"), 256), 1, 12)
        return F.when(F.length(v) > 64, F.concat(F.substring(v, 1, 48), F.lit("_"), tail)).otherwise(v)

    def renamed(v: Column) -> Column:
        reserved = F.upper(tx.before(v, ".")).isin(*names.RESERVED_STEMS)
        return tx.let(F.when(reserved, F.concat(F.lit("_"), v)).otherwise(v), shortened)

    return tx.let(value, renamed)


def _safe_name(value: Column, empty: str) -> Column:
    value = F.regexp_replace(value, r"(?U)[^\w\-.]", "_")
    value = F.btrim(F.regexp_replace(value, r"_+", "_"), F.lit("_."))
    return portable_segment(tx.or_else(value, empty))


def safe_dirname(name: Column) -> Column:
    return _safe_name(F.lower(tx.strip(name)), "unknown")


def safe_segment(segment: Column) -> Column:
    decoded = tx.strip(urls.percent_decode(segment, plus=False))
    return _safe_name(tx.before(tx.before(decoded, "?"), "#"), "_")


def path_segments(path: Column, url: Column | None = None) -> Column:
    """Site-map segments of a path, each made safe; ``['root']`` for an empty path."""
    raw = path if url is None else F.when(F.coalesce(path, F.lit("")) != "", path).otherwise(urls.path(url))
    parts = F.filter(F.split(tx.before(tx.before(raw, "?"), "#"), "/"), lambda s: tx.strip(s) != "")
    return F.when(F.size(parts) == 0, F.array(F.lit("root"))).otherwise(F.transform(parts, safe_segment))


def is_sensitive_name(name: Column) -> Column:
    lower = F.lower(name)
    return lower.isin(*names.SENSITIVE_NAMES) | lower.rlike(names.SENSITIVE_FRAGMENTS)


def body_language(mime: Column, content: Column) -> Column:
    """Guess json/html/xml/javascript/css from the MIME type or the first 200 characters."""
    mime = F.lower(mime)
    start = tx.strip(F.substring(content, 1, 200))
    lower = F.lower(start)
    return (
        F.when(mime.contains("json") | start.startswith("{") | start.startswith("["), F.lit("json"))
        .when(mime.contains("html") | lower.startswith("<!doctype") | lower.startswith("<html"), F.lit("html"))
        .when(mime.contains("xml") | start.startswith("<"), F.lit("xml"))
        .when(mime.contains("js") | mime.contains("javascript"), F.lit("javascript"))
        .when(mime.contains("css"), F.lit("css"))
        .otherwise(F.lit(""))
    )


# -- endpoint keys -----------------------------------------------------------
def endpoint(method: Column, path: Column) -> Column:
    return F.concat(method, F.lit(" "), path)


def origin_endpoint(method: Column, protocol: Column, host: Column, port: Column, path: Column) -> Column:
    return F.concat(method, F.lit(" "), protocol, F.lit("://"), host, F.lit(":"), port, path)


def generalise(endpoint_text: Column) -> Column:
    """Replace id-like path parts by ``/{id}``: 36-character hex ids first, then digits."""
    out = F.regexp_replace(endpoint_text, r"/[0-9a-fA-F\-]{36}", "/{id}")
    return F.regexp_replace(out, r"/[0-9]+", "/{id}")


# -- sessions ----------------------------------------------------------------
def _session_sources(headers: Column, url: Column) -> Column:
    """``name:value`` of the auth headers, else of session-like query keys."""
    from_headers = F.transform(
        F.filter(headers, lambda h: F.lower(h["name"]).isin(*names.AUTH_HEADERS)),
        lambda h: F.concat(F.lower(h["name"]), F.lit(":"), h["value"]),
    )
    from_query = F.transform(
        F.filter(
            urls.query_pairs(urls.query(url), keep_blank=True),
            lambda p: F.lower(p["name"]).isin(*names.SESSION_QUERY_KEYS),
        ),
        lambda p: F.concat(p["name"], F.lit(":"), p["value"]),
    )
    return tx.let(from_headers, lambda found: F.when(F.size(found) > 0, found).otherwise(from_query))


def _session_names(headers: Column, url: Column, named) -> Column:
    """``named(short, whole)`` for the names with 8 and with all digits of one hash of the session sources."""

    def both(sources: Column) -> Column:
        digest = F.when(F.size(sources) > 0, F.sha2(F.array_join(F.array_sort(sources), "|").cast("binary"), 256))
        name = lambda digits: F.coalesce(F.concat(F.lit("session_"), digits), F.lit("session_anon"))
        return tx.let(digest, lambda d: named(name(F.substring(d, 1, 8)), name(d)))

    return tx.let(_session_sources(headers, url), both)


def session_tag(headers: Column, url: Column) -> Column:
    """Short bucket label from auth headers, else from session-like query keys; for display."""
    return _session_names(headers, url, lambda short, whole: short)


def session_key(tag: Column, headers: Column, url: Column) -> Column:
    """The tag with the whole hash, for grouping: 32 bits collide from some 80,000 sessions on.

    A tag that does not come from these headers and this URL (another tool's, or of masked items) is its own key.
    """
    return _session_names(headers, url, lambda short, whole: F.when(tag == short, whole).otherwise(tag))


def journey_session(tag: Column, headers: Column) -> Column:
    """Session part of the journey key: the tag, else the first auth value, else ``unauthenticated``."""
    auth = F.get(F.filter(headers, lambda h: F.lower(h["name"]).isin("authorization", "cookie")), F.lit(0))["value"]
    return F.when(F.coalesce(tag, F.lit("")) != "", tag).otherwise(F.coalesce(tx.strip(auth), F.lit("unauthenticated")))


# -- time --------------------------------------------------------------------
def flexible_time(text: Column) -> Column:
    """Zoned ISO, ``yyyy-MM-dd HH:mm[:ss]`` or a date; anything else fails, blank is null."""
    value = tx.strip(text)
    iso = F.when(
        value.rlike(r"^\d{4}-\d{2}-\d{2}T.*(?:Z|[+-]\d{2}:?\d{2})(?:\[[^\]]+\])?$"),
        F.try_to_timestamp(F.regexp_replace(value, r"\[[^\]]+\]$", "")),
    )
    plain = F.when(
        value.rlike(r"^\d{4}-\d{2}-\d{2}(?: \d{2}:\d{2}(?::\d{2})?)?$"), F.try_to_timestamp(value)
    )
    parsed = F.coalesce(iso, plain)
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(None).cast("timestamp")).otherwise(
        F.coalesce(parsed, F.raise_error(F.concat(F.lit("Invalid time: "), text)).cast("timestamp"))
    )


def lenient_time(text: Column) -> Column:
    return F.try_to_timestamp(F.regexp_replace(tx.strip(text), r"\[[^\]]+\]$", ""))


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)

"""Message, URL and text normalisation (P) and redaction (R)."""

from __future__ import annotations

from pyspark.sql import functions as F

from httploom.functions import http, names, redact, urls
from httploom.functions import text as tx
from httploom.operators import dedup, findings

from . import fixtures as fx
from .registry import query


def _request():
    return F.col("request_raw")


def _response():
    return F.col("response_raw")


@query("p01_decode_field", f"with {fx.TD} select idx, response_body as text from td")
def decode_field(spark, sf):
    """Documents as base64 with line breaks: even rows UTF-8, odd rows decoded by the same rule."""
    rows = fx.td(spark, sf)
    encoded = F.regexp_replace(F.base64(F.encode("response_body", "UTF-8")), "(.{60})", "$1\n")
    return rows.select("idx", http.decode_field(encoded, F.lit(True)).alias("text"))


@query("p01_decode_latin1", "select doc_id + 1 as idx, text from documents where not regexp_matches(text, '[^\\x{00}-\\x{ff}]') and regexp_matches(text, '[\\x{80}-\\x{ff}]')")
def decode_latin1(spark, sf):
    """Latin-1 bytes that are not UTF-8 fall back to Latin-1."""
    rows = fx.td(spark, sf).where(
        ~F.col("response_body").rlike(r"[^\x00-\xff]") & F.col("response_body").rlike(r"[\x80-\xff]")
    )
    encoded = F.base64(F.encode("response_body", "ISO-8859-1"))
    return rows.select("idx", http.decode_field(encoded, F.lit(True)).alias("text"))


@query("p02_split_message", f"""with {fx.TI} select idx, method || ' ' || path || case when query <> '' then '?' || query else '' end || ' HTTP/1.1' as first_line,
  request_headers_text as headers, request_body as body from ti""")
def split_message(spark, sf):
    rows = fx.te_messages(spark, sf)
    return rows.select(
        "idx", http.first_line(_request()).alias("first_line"), F.array_join(http.header_lines(_request()), "\n").alias("headers"), http.body(_request()).alias("body")
    )


@query("p03_merge_headers", f"""with {fx.TE} select idx, case when response_headers_text like '%Set-Cookie%'
  then 'sid=s' || user_id || '; Secure|pref=1; HttpOnly; SameSite=Lax' else '' end as cookies,
  len(list_distinct(list_transform(string_split(response_headers_text, chr(10)), lambda x: split_part(x, ':', 1)))) as names from te""")
def merge_headers(spark, sf):
    merged = fx.te_messages(spark, sf).select("idx", http.headers_of(_response()).alias("h"))
    return merged.select(
        "idx", F.replace(http.header_value(F.col("h"), "set-cookie"), F.lit("\n"), F.lit("|")).alias("cookies"),
        F.size("h").cast("long").alias("names"),
    )


@query("p04_status_line", f"with {fx.TE} select idx, 'HTTP/1.1 ' || status || ' R' as status_line, status from te")
def status_line(spark, sf):
    rows = fx.te_messages(spark, sf).select("idx", http.first_line(_response()).alias("status_line"))
    return rows.withColumn("status", http.status_code(F.col("status_line")))


@query("p05_request_line", f"with {fx.TE} select idx, method, path || case when query <> '' then '?' || query else '' end as target, path from te")
def request_line(spark, sf):
    line = http.first_line(_request())
    rows = fx.te_messages(spark, sf).select("idx", http.request_method(line).alias("method"), http.request_target(line).alias("target"))
    return rows.withColumn("path", http.target_path(F.col("target")))


@query("p06_extension", f"with {fx.TP} select idx, regexp_extract(path || case when idx % 3 = 0 then '/a.tar.gz' when idx % 3 = 1 then '/.hidden' else '' end, '(?:^|/)[^/]+\\.([^./]+)$', 1) as extension from tp")
def extension(spark, sf):
    tail = F.when(F.col("idx") % 3 == 0, F.lit("/a.tar.gz")).when(F.col("idx") % 3 == 1, F.lit("/.hidden")).otherwise(F.lit(""))
    return fx.tp(spark, sf).select("idx", http.extension(F.concat("path", tail)).alias("extension"))


@query("p07_rebuild_url", f"""with {fx.TI} select idx, case idx % 4 when 0 then url when 1 then replace(url, '.example.test', '.example.test:8443')
  when 2 then url else protocol || '://[::1]' || path || case when query <> '' then '?' || query else '' end end as url from ti""")
def rebuild_url(spark, sf):
    rows = fx.te_messages(spark, sf)
    kind = F.col("idx") % 4
    target = http.request_target(http.first_line(_request()))
    return rows.select(
        "idx",
        http.rebuild_url(
            F.col("protocol"), F.when(kind == 3, F.lit("::1")).otherwise(F.col("host")),
            F.when(kind == 1, F.lit("8443")).otherwise(F.col("port")),
            F.when(kind == 2, F.concat(F.lit("http://other.test"), target)).otherwise(target), F.col("path"),
        ).alias("url"),
    )


@query("p08_mime_type", f"with {fx.TE} select idx, 'application/json' as mime_type from te")
def mime_type(spark, sf):
    raw = F.replace(_response(), F.lit("application/json"), F.lit("application/json ; charset=utf-8"))
    return fx.te_messages(spark, sf).select("idx", http.mime_type(http.headers_of(raw)).alias("mime_type"))


@query("p09_rebuild_message", f"with {fx.TI} select idx, request_raw, response_raw from ti")
def rebuild_message(spark, sf):
    rows = fx.te_messages(spark, sf)
    return rows.select(
        "idx", http.rebuild(http.first_line(_request()), http.headers_of(_request()), http.body(_request())).alias("request_raw"),
        http.rebuild(http.first_line(_response()), http.headers_of(_response()), http.body(_response())).alias("response_raw"),
    )


@query("p10_normalise_tool", """select event_type, count(*) as n, case event_type when 'view' then 'proxy' when 'click' then 'target' when 'signup' then 'proxy'
  when 'purchase' then 'repeater' when 'error' then 'error' else event_type end as tool from events group by event_type""")
def normalise_tool(spark, sf):
    given = F.create_map(
        *[F.lit(x) for x in ("view", " 2 ", "click", "Site Map", "signup", "HTTP history", "purchase", "My Repeater tab")]
    )
    events = fx.table(spark, sf, "events")
    counted = events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("tool", http.normalise_tool(F.coalesce(given[F.col("event_type")], F.col("event_type"))))


@query("p11_infer_tool", """select doc_id + 1 as idx, case when lower(text) like '%repeater%' then 'repeater' when lower(text) like '%intruder%' then 'intruder'
  when lower(text) like '%scan%' then 'scanner' else 'proxy' end as tool from documents""")
def infer_tool(spark, sf):
    return fx.td(spark, sf).select("idx", http.infer_tool(F.col("response_body")).alias("tool"))


@query("p12_fill_from_url", f"with {fx.TP} select idx, lower(host) as host, protocol, case when idx % 2 = 0 then '8080' else '' end as port from tp")
def fill_from_url(spark, sf):
    from httploom.sources import exports

    rows = fx.tp(spark, sf).select(
        "idx", F.when(F.col("idx") % 2 == 0, F.regexp_replace("url", "(://[^/?#]+)", "$1:8080")).otherwise(F.col("url")).alias("url"),
        F.lit("").alias("xml_host"), F.lit("").alias("xml_protocol"), F.lit("").alias("xml_port"),
    )
    return exports.fill_from_url(rows).select("idx", "host", "protocol", "port")


@query("p13_hash", f"with {fx.TI} select idx, sha256 from ti")
def request_hash(spark, sf):
    return fx.te_messages(spark, sf).select("idx", F.sha2(_request().cast("binary"), 256).alias("sha256"))


@query("p14_slug", f"with {fx.TI} select idx, slug from ti")
def slug(spark, sf):
    return fx.te(spark, sf).select("idx", http.slug(F.col("idx"), F.col("method"), F.col("path")).alias("slug"))


@query("p15_safe_segments", f"""with {fx.TP}, s as (select idx, list_filter(string_split(path, '/'), lambda x: x <> '') as segs from tp)
  select idx, case when len(segs) = 0 then 'root' else array_to_string(segs, '|') end
   || '|_con.txt|' || left(repeat('a', 70), 48) || '_' || left(sha256(repeat('a', 70)), 12) || '|_|x_y' as segments from s""")
def safe_segments(spark, sf):
    """Each path followed by a reserved name, a long name, a dot-dot and an escaped blank."""
    extra = "/con.txt/" + "a" * 70 + "/%2e%2e/x%20y"
    base = F.when(F.regexp_replace("path", "/", "") == "", F.lit("/root")).otherwise(F.col("path"))
    return fx.tp(spark, sf).select("idx", F.array_join(http.path_segments(F.concat(base, F.lit(extra))), "|").alias("segments"))


@query("p16_query_pairs", f"""with {fx.TP}, q as (select idx, unnest(string_split(query, '&')) as p from tp where query <> '')
  select idx, split_part(p, '=', 1) as name, url_decode(replace(split_part(p, '=', 2), '+', ' ')) as value from q where split_part(p, '=', 2) <> ''""")
def query_pairs(spark, sf):
    return fx.tp(spark, sf).select("idx", F.inline(urls.query_pairs(F.col("query"))))


@query("p16_query_pairs_blank", f"""with {fx.TE}, q as (select idx, unnest(string_split('a+b=&' || query || '&flag&bad=%zz%41', '&')) as p from te)
  select idx, replace(split_part(p, '=', 1), '+', ' ') as name, case when p like 'bad%' then '%zzA' else url_decode(split_part(p, '=', 2)) end as value from q where p <> ''""")
def query_pairs_blank(spark, sf):
    qs = F.concat(F.lit("a+b=&"), "query", F.lit("&flag&bad=%zz%41"))
    return fx.te(spark, sf).select("idx", F.inline(urls.query_pairs(qs, keep_blank=True)))


@query("p18_set_cookies", f"""with {fx.TE} select idx, unnest(['sid', 'pref']) as name, unnest(['secure', 'httponly,samesite']) as flags from te where response_headers_text like '%Set-Cookie%'""")
def set_cookies(spark, sf):
    rows = fx.te_items(spark, sf).select(F.col("index").alias("idx"), F.inline(http.set_cookies(F.col("response_headers"))))
    return rows.withColumn("flags", F.array_join("flags", ","))


@query("p19_token_parts", f"""with {fx.TD} select idx, case when idx % 3 = 0 then 'none' else 'HS256' end as alg, cast(idx as varchar) as sub from td""")
def token_parts(spark, sf):
    from . import finding_queries

    from httploom.functions import names

    rows = finding_queries.tokens_from_documents(spark, sf).select(
        F.col("index").alias("idx"), F.get(F.regexp_extract_all("response_raw", F.lit(names.JWT_PATTERN), 0), F.lit(0)).alias("token")
    )
    parts = F.split("token", r"\.")
    return rows.select(
        "idx", F.try_variant_get(findings.decode_token_part(parts[0]), "$.alg", "string").alias("alg"),
        F.try_variant_get(findings.decode_token_part(parts[1]), "$.sub", "string").alias("sub"),
    )


@query("p23_endpoint_keys", f"with {fx.TI} select idx, method || ' ' || path as endpoint, method || ' https://' || host || ':443' || path as origin_endpoint, 'https://' || host as origin, path as url_path from ti")
def endpoint_keys(spark, sf):
    return fx.te_items(spark, sf).select(
        F.col("index").alias("idx"), http.endpoint(F.col("method"), F.col("path")).alias("endpoint"),
        http.origin_endpoint(F.col("method"), F.col("protocol"), F.col("host"), F.col("port"), F.col("path")).alias("origin_endpoint"),
        urls.origin(F.col("url")).alias("origin"), urls.path(F.col("url")).alias("url_path"),
    )


@query("p24_generalise", f"""with {fx.TP} select idx, regexp_replace(regexp_replace(method || ' ' || path, '/[0-9a-fA-F\\-]{{36}}', '/{{id}}', 'g'), '/[0-9]+', '/{{id}}', 'g') as endpoint from tp""")
def generalise(spark, sf):
    return fx.tp(spark, sf).select("idx", http.generalise(http.endpoint(F.col("method"), F.col("path"))).alias("endpoint"))


@query("p25_session_tag", f"""with {fx.TI} select idx, case when session_tag = 'session_anon' then 'session_' || left(sha256('token:a b'), 8) else session_tag end as session_tag from ti""")
def session_tag(spark, sf):
    """Requests without auth headers fall back to a session-like query key."""
    url = F.concat(F.col("url"), F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("token=a+b"))
    return fx.te_items(spark, sf).select(F.col("index").alias("idx"), http.session_tag(F.col("request_headers"), url).alias("session_tag"))


@query("p26_journey_session", f"""with {fx.TI} select idx, case when idx % 2 = 0 then session_tag when user_id % 3 <> 0 then 'Bearer u' || user_id
  when user_id % 2 = 0 then 'sid=s' || user_id || '; theme=dark' else 'unauthenticated' end as session from ti""")
def journey_session(spark, sf):
    tag = F.when(F.col("index") % 2 == 0, F.col("session_tag")).otherwise(F.lit(""))
    return fx.te_items(spark, sf).select(F.col("index").alias("idx"), http.journey_session(tag, F.col("request_headers")).alias("session"))


@query("p27_flexible_time", """select event_id + 1 as idx, case event_id % 4 when 0 then date_trunc('second', ts) when 1 then date_trunc('minute', ts)
  when 2 then date_trunc('day', ts) else date_trunc('second', ts) - interval 2 hour end as time from events""")
def flexible_time(spark, sf):
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
        .when(kind == 1, F.date_format("ts", "yyyy-MM-dd HH:mm"))
        .when(kind == 2, F.date_format("ts", "yyyy-MM-dd"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+02:00[Europe/Berlin]'"))
    )
    events = fx.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return events.select((F.col("event_id") + 1).alias("idx"), http.flexible_time(text).cast("timestamp_ntz").alias("time"))


@query("p28_body_language", f"""with {fx.TP} select idx, case when idx % 3 = 0 then 'html' when idx % 3 = 1 then case when response_body like '<!DOCTYPE%' or lower(response_body) like '<html%' then 'html' when response_body like '<%' then 'xml' else '' end else 'css' end as language from tp""")
def body_language(spark, sf):
    kind = F.col("idx") % 3
    mime = F.when(kind == 0, F.lit("HTML")).when(kind == 1, F.lit("")).otherwise(F.lit("text/css"))
    body = F.when(kind == 2, F.lit("a{}")).otherwise(F.col("response_body"))
    return fx.tp(spark, sf).select("idx", http.body_language(mime, body).alias("language"))


@query("p29_bounded", f"with {fx.TD} select idx, left(response_body, 2000) as text, length(response_body) > 2000 as truncated from td")
def bounded(spark, sf):
    return fx.td(spark, sf).select("idx", tx.bounded(F.col("response_body"), 2000).alias("b")).select("idx", "b.text", "b.truncated")


@query("p30_content_id", f"with {fx.TI} select idx, 'T' || left(sha256(slug), 12) as evidence_id from ti")
def content_id(spark, sf):
    return fx.te_items(spark, sf).select(F.col("index").alias("idx"), tx.content_id("T", F.col("slug")).alias("evidence_id"))


# -- redaction ---------------------------------------------------------------
_MASKED_HEADERS = """regexp_replace(regexp_replace(request_headers_text, '(Authorization|Cookie): [^\\n]*', '\\1: [REDACTED]', 'g'), chr(10), chr(13) || chr(10), 'g')"""


@query("r01_text", f"with {fx.TE} select idx, {fx.MASKED_BODY} as text from te")
def redact_text(spark, sf):
    return fx.te(spark, sf).select("idx", redact.message_body(F.col("request_body")).alias("text"))


@query("r02_json", f"with {fx.TE} select idx, case when request_body like '{{%' then {fx.MASKED_BODY} end as text from te")
def redact_json(spark, sf):
    """JSON bodies masked as trees; null for bodies that are not JSON."""
    return fx.te(spark, sf).select("idx", redact.json_text(F.col("request_body")).alias("text"))


@query("r03_url", f"""with {fx.TP} select idx, protocol || '://' || lower(host) || path || '?' || case when query = '' then '' else query || '&' end || 'api_key=%5BREDACTED%5D&key=%5BREDACTED%5D&n=1' as url from tp""")
def redact_url(spark, sf):
    rows = fx.tp(spark, sf)
    given = F.concat(
        "protocol", F.lit("://user:pw@"), F.lower("host"), "path", F.lit("?"),
        F.when(F.col("query") == "", F.lit("")).otherwise(F.concat("query", F.lit("&"))), F.lit("api_key=abc&key=1&n=1#frag"),
    )
    return rows.select("idx", redact.url(given).alias("url"))


@query("r04_message", f"""with {fx.TI} select idx, method || ' ' || path || case when query <> '' then '?' || query else '' end || ' HTTP/1.1' || chr(13) || chr(10) || {_MASKED_HEADERS}
  || chr(13) || chr(10) || chr(13) || chr(10) || {fx.MASKED_BODY} as message from ti""")
def redact_message(spark, sf):
    return fx.te_messages(spark, sf).select("idx", redact.message(_request()).alias("message"))


@query("r05_items", f"""with {fx.TI} select idx, url, path, slug, {fx.MASKED_BODY} as request_body,
  case when response_body like '{{%' then replace(response_body, ':', ': ') else response_body end as response_body,
  method || ' ' || path || case when query <> '' then '?' || query else '' end || ' HTTP/1.1' || chr(13) || chr(10) || {_MASKED_HEADERS}
  || chr(13) || chr(10) || chr(13) || chr(10) || {fx.MASKED_BODY} as request_raw, 0 as leaks from ti""")
def redact_items(spark, sf):
    """Every field of every item; ``leaks`` counts secrets still visible anywhere."""
    masked = dedup.redact_items(fx.te_items(spark, sf))
    everything = F.to_json(F.struct(*masked.columns))
    # Every leak holds one of these, which are found faster than the pattern.
    suspicious = lambda text: http.any_of(*[text.contains(part) for part in ("Bearer u", "sid=s", "password=p", "theme=dark", "token")])
    leak = tx.let(everything, lambda text: suspicious(text) & text.rlike(r"Bearer u\d|sid=s\d|password=p|theme=dark|token[\\\": ]+t\d"))
    return masked.select(
        F.col("index").alias("idx"), "url", "path", "slug", "request_body", "response_body", "request_raw", leak.cast("int").alias("leaks")
    )


_MASKED_SOURCE = "response_body"
for _pattern, _mask in ((names.SOURCE_SECRET_LITERAL, r'\1"' + names.MASK + '"'), (names.SECRET_TOKEN, names.MASK)):
    _MASKED_SOURCE = "regexp_replace({}, '{}', '{}', 'g')".format(_MASKED_SOURCE, _pattern.replace("'", "''"), _mask)


@query("r06_source", f"""with {fx.TD} select idx, len(string_split(response_body, chr(10))) + 5 as line_count, 0 as leaks,
  {_MASKED_SOURCE} || chr(10) || 'const api_key = "{names.MASK}";' || chr(10) || '[REDACTED PRIVATE KEY]' || repeat(chr(10), 3) || 'end' as masked from td""")
def redact_source(spark, sf):
    """Documents with a key block and quoted secrets appended: masked, line count kept."""
    planted = (
        '\nconst api_key = "k-secret-1";\n-----BEGIN RSA PRIVATE KEY-----\nk-secret-2\n-----END RSA PRIVATE KEY-----\nend'
    )
    rows = fx.td(spark, sf).withColumn("masked", redact.source(F.concat("response_body", F.lit(planted))))
    return rows.select(
        "idx", F.size(F.split("masked", "\n")).cast("long").alias("line_count"),
        F.col("masked").contains("k-secret").cast("int").alias("leaks"), "masked",
    )

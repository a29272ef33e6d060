"""Review rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from httploom.operators import findings as fd

from . import fixtures as fx
from .registry import query

_OUT = ["category", "severity", "title", "detail", "host", "slug"]


def shown(df):
    return df.select("category", "severity", "title", "detail", "host", F.array_join("items", ",").alias("slug"))


def _sql(category, severity, title, detail, where, slug="slug", source="ti", ctes=None):
    return (
        f"with {ctes or fx.TI} select '{category}' as category, '{severity}' as severity, {title} as title, "
        f"{detail} as detail, host, {slug} as slug from {source} where {where}"
    )


_EP = "method || ' ' || path"
_PATH_ID = "regexp_extract(path, '/([0-9]{1,10})(/|$)', 1)"

ids_sql = _sql(
    "IDOR", "High", f"'Potential IDOR: ' || {_EP}",
    f"'Numeric/predictable identifiers: ' || concat_ws(', ', case when {_PATH_ID} <> '' then 'path=' || {_PATH_ID} end, "
    "case when query like 'id=%' then 'param:id=' || substr(query, 4) end, "
    "case when request_body like '{%' then 'json:user_id=' || user_id end, "
    "case when request_body like 'order_id=%' then 'body:order_id=' || k end)",
    f"{_PATH_ID} <> '' or query like 'id=%' or request_body <> ''",
)


@query("d01_ids", ids_sql)
def ids(spark, sf):
    return shown(fd.row_findings(fx.te_items(spark, sf), fd.id_rule()))


@query("d01_ids_pages", f"""with {fx.TP}, p as (select idx, path, host,
  regexp_extract_all(path, '/([0-9]{{1,10}})(?:/|$)', 1) as ids from tp)
  select idx, host, 'Numeric/predictable identifiers: ' || array_to_string(list_transform(ids, lambda x: 'path=' || x), ', ') as detail
  from p where len(ids) > 0""")
def ids_pages(spark, sf):
    found = fd.row_findings(fx.tp_items(spark, sf), fd.id_rule())
    return found.select(F.col("ord").alias("idx"), "host", "detail")


reflected_sql = _sql(
    "Reflected Input (XSS candidate)", "High", f"'Reflected param ''q'' in response: ' || {_EP}",
    "'Value ''term' || k || ''' from query param ''q'' appears in response body.'", "query like 'q=term%'",
)


@query("d02_reflected", reflected_sql)
def reflected(spark, sf):
    return shown(fd.row_findings(fx.te_items(spark, sf), fd.reflected_rule()))


errors_sql = _sql(
    "Information Disclosure", "Medium", f"'Unhandled exception: ' || {_EP} || ' [' || status || ']'",
    "'Response contains unhandled exception pattern.'", "regexp_matches(response_body, '(?i)internal server error')",
)


@query("d03_errors", errors_sql)
def errors(spark, sf):
    return shown(fd.row_findings(fx.te_items(spark, sf), fd.error_rule()))


_SENSITIVE = """case when regexp_matches(response_body, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b') then 'email address'
 when regexp_matches(response_body, '\\b\\d{3}-\\d{2}-\\d{4}\\b') then 'SSN-like number'
 when regexp_matches(response_body, '\\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13})\\b') then 'credit card number'
 when regexp_matches(response_body, '(?i)(?:password|passwd|secret|private.?key)\\s*[:=]\\s*["'']?[^\\s"'',}{]{4,}') then 'hardcoded secret'
 when regexp_matches(response_body, '(?i)(?:aws_?access_?key|AKIA)[A-Z0-9]{12,}') then 'AWS key'
 when regexp_matches(response_body, '(?i)(?:sk-|pk_live_|pk_test_|sk_live_|sk_test_)[A-Za-z0-9]{20,}') then 'API secret key'
 when regexp_matches(response_body, '(?i)(?:ghp|gho|ghu|ghs|ghr)_[a-zA-Z0-9]{36}') then 'GitHub Token'
 when regexp_matches(response_body, 'xox[baprs]-[0-9]{10,13}-[a-zA-Z0-9]{24}') then 'Slack Token' end"""


@query("d04_sensitive", f"""with {fx.TD}, s as (select *, {_SENSITIVE} as label from td)
  select idx, 'Sensitive Data Exposure' as category, 'High' as severity, label || ' in response: ' || {_EP} as title,
  'Matched pattern: ''[REDACTED]...''' as detail, host from s where label is not null""")
def sensitive(spark, sf):
    found = fd.row_findings(fx.td_items(spark, sf), fd.sensitive_rule())
    return found.select(F.col("ord").alias("idx"), "category", "severity", "title", "detail", "host")


def tokens_from_documents(spark, sf):
    """Unsigned tokens built from the documents: claims differ with the document id."""
    segment = lambda text: F.translate(F.rtrim(F.base64(F.encode(text, "UTF-8")), F.lit("=")), "+/", "-_")
    doc = F.col("index").cast("string")
    alg = F.when(F.col("index") % 3 == 0, F.lit("none")).otherwise(F.lit("HS256"))
    header = F.concat(F.lit('{"alg":"'), alg, F.lit('"}'))
    claim = F.when(F.col("index") % 2 == 0, F.lit('"password":"x",')).otherwise(F.lit(""))
    payload = F.concat(F.lit("{"), claim, F.lit('"sub":"'), doc, F.lit('"}'))
    token = F.concat(segment(header), F.lit("."), segment(payload), F.lit(".sig"))
    items = fx.td_items(spark, sf)
    return items.withColumn(
        "response_raw", F.concat(F.lit("HTTP/1.1 200 OK\r\n\r\n"), F.col("response_body"), F.lit(" "), token)
    )


@query("d05_tokens", f"""with {fx.TD}
  select idx, concat_ws(' | ', case when idx % 3 = 0 then 'Algorithm set to ''none''' end,
   case when idx % 2 = 0 then 'Sensitive claims: [''password'']' end) as detail, host
  from td where idx % 3 = 0 or idx % 2 = 0""")
def tokens(spark, sf):
    found = fd.row_findings(tokens_from_documents(spark, sf), fd.jwt_rule())
    return found.select(F.col("ord").alias("idx"), "detail", "host")


unauth_sql = _sql(
    "Authentication", "Medium", f"'Unauthenticated 2xx: ' || {_EP}",
    "'Endpoint returned success without any auth headers in request.'",
    "status like '2%' and user_id % 3 = 0 and user_id % 2 <> 0",
)


@query("d06_unauthenticated", unauth_sql)
def unauthenticated(spark, sf):
    return shown(fd.row_findings(fx.te_items(spark, sf), fd.unauthenticated_rule()))


cors_sql = _sql(
    "CORS Misconfiguration", "Info", f"'Wildcard CORS review: ' || {_EP}",
    "'Any origin can read noncredentialed responses. This may be intentional for public resources; browsers reject wildcard origins with credentials.'",
    "k % 10 = 0",
)


@query("d07_cors", cors_sql)
def cors(spark, sf):
    return shown(fd.row_findings(fx.te_items(spark, sf), fd.cors_rule()))


cookies_sql = f"""select category, severity, 'Cookie review ''' || name || ''' on ' || host as title,
  'Cookie flags: ' || issues || '. Assess against the cookie purpose.' as detail, host, arg_min(slug, idx) as slug from (
  select 'Cookie Security' as category, 'Medium' as severity, host, idx, slug, unnest(['sid', 'pref']) as name,
   unnest(['missing HttpOnly, missing SameSite', 'missing Secure']) as issues from ti where response_headers_text like '%Set-Cookie%')
  group by category, severity, name, host, issues"""


@query("d08_cookies", f"with {fx.TI} {cookies_sql}")
def cookies(spark, sf):
    return shown(fd.cookie_findings(fx.te_items(spark, sf)))


redirect_sql = _sql(
    "Open Redirect", "Medium", f"'Open redirect candidate: ' || {_EP}",
    "'Param ''redirect'' = ''https://example.invalid'' contains external URL.'", "query like '%&redirect=%'",
)


@query("d09_redirects", redirect_sql)
def redirects(spark, sf):
    return shown(fd.row_findings(fx.te_items(spark, sf), fd.redirect_rule()))


_HEADERS = [
    "content-security-policy", "cross-origin-opener-policy", "cross-origin-resource-policy", "permissions-policy",
    "referrer-policy", "strict-transport-security", "x-content-type-options", "x-frame-options",
]
_missing = f"""missing as (select h.host, n.name from (select distinct host from ti) h, (select unnest({_HEADERS}) as name) n
  where not exists (select 1 from ti where ti.host = h.host and (chr(10) || lower(response_headers_text)) like '%' || chr(10) || n.name || ':%'))"""
headers_sql = """select 'Security Headers' as category, 'Medium' as severity, 'Missing security headers on ' || host as title,
  'Headers never observed: ' || string_agg(name, ', ' order by name) as detail, host, '' as slug from missing group by host"""


@query("d10_headers", f"with {fx.TI}, {_missing} {headers_sql}")
def headers(spark, sf):
    return shown(fd.header_findings(fx.te_items(spark, sf)))


@query("a09_missing_headers", f"with {fx.TI}, {_missing} select host, string_agg(name, ', ' order by name) as missing from missing group by host")
def missing_headers(spark, sf):
    return fd.missing_security_headers(fx.te_items(spark, sf)).select("host", "missing")


methods_sql = """select 'HTTP Methods' as category, 'Low' as severity, 'State-changing methods on ' || path as title,
  'Methods observed: ' || string_agg(distinct method, ', ' order by method) || '. Verify authorization checks.' as detail, host, '' as slug
  from ti where method in ('PUT', 'DELETE', 'PATCH', 'TRACE', 'OPTIONS') group by host, path"""


@query("d11_methods", f"with {fx.TI} {methods_sql}")
def methods(spark, sf):
    return shown(fd.method_findings(fx.te_items(spark, sf)))


@query("a10_state_changing", f"""with {fx.TI} select host, path, string_agg(distinct method, ', ' order by method) as methods
  from ti where method in ('PUT', 'DELETE', 'PATCH', 'TRACE', 'OPTIONS') group by host, path""")
def state_changing(spark, sf):
    return fd.state_changing_methods(fx.te_items(spark, sf)).select("host", "path", "methods")


def keyed_documents(spark, sf):
    """Documents whose body carries a key-shaped token on every fifth row."""
    token = F.concat(F.lit("ghp_"), F.substring(F.sha2(F.col("index").cast("string"), 256), 1, 36))
    return fx.td_items(spark, sf).withColumn(
        "response_body", F.when(F.col("index") % 5 == 0, F.concat("response_body", F.lit(" "), token)).otherwise(F.col("response_body"))
    )


_KEYED = """regexp_matches(case when idx % 5 = 0 then response_body || ' ghp_' || left(sha256(cast(idx as varchar)), 36) else response_body end,
  'ghp_[A-Za-z0-9]{36}|xox[baprs]-[a-zA-Z0-9]{10,}')"""


@query("a13_api_key_endpoints", f"with {fx.TD} select idx, host, method || ' ' || path as endpoint from td where {_KEYED}")
def api_key_endpoints(spark, sf):
    return fd.api_key_endpoints(keyed_documents(spark, sf)).select(F.col("index").alias("idx"), "host", "endpoint")


@query("d12_api_secrets", f"""with {fx.TD} select 'Sensitive Data' as category, 'High' as severity, 'API Secrets Discovered' as title,
  'Potential API keys (GitHub, Slack, etc.) were found in the HTTP traffic.' as detail, host,
  method || ' ' || path as slug from td where {_KEYED} group by host, method || ' ' || path""")
def api_secrets(spark, sf):
    return shown(fd.api_secret_findings(keyed_documents(spark, sf)))


_ROW_SELECTS = [sql.split("from ti0) ", 1)[1] for sql in (ids_sql, reflected_sql, errors_sql, unauth_sql, cors_sql, redirect_sql)]
# `te` bodies hold one pattern of the sensitive rule: none, so its part is empty.
all_sql = " union all ".join([*_ROW_SELECTS, f"({cookies_sql})", f"({headers_sql})", f"({methods_sql})"])
ALL = f"{fx.TI}, {_missing}, findings as ({all_sql})"


@query("d13_all_findings", f"with {ALL} select * from findings")
def all_findings(spark, sf):
    return shown(fd.all_findings(fx.te_items(spark, sf)))


@query("a11_counts", f"""with {ALL} select coalesce(severity, 'all') as severity, coalesce(category, 'all') as category, count(*) as findings
  from findings group by rollup(severity, category)""")
def counts(spark, sf):
    return fd.count_by_severity(fd.all_findings(fx.te_items(spark, sf)))


_RANK = "case severity when 'Critical' then 0 when 'High' then 1 when 'Medium' then 2 when 'Low' then 3 else 4 end"


@query("w12_sorted_findings", f"with {ALL} select {_RANK} as severity_rank, category, title, detail, host, slug from findings")
def sorted_findings(spark, sf):
    ordered = fd.sort_findings(fd.all_findings(fx.te_items(spark, sf)))
    return ordered.select(
        fd.severity_rank(F.col("severity")).alias("severity_rank"), "category", "title", "detail", "host",
        F.array_join("items", ",").alias("slug"),
    )

"""Review evidence per endpoint and matching of rewritten paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from httploom.functions import names
from httploom.operators import context, evidence, findings, mapping

from . import fixtures as fx
from .finding_queries import _EP
from .mapping_queries import _TE_RESPONSE, _header_json
from .registry import query

REWRITES = [
    {"origin": "https://h1.example.test", "from": "/items", "to": "/v2"},
    {"origin": "https://h2.example.test", "from": "/", "to": "/gateway/"},
]
# Routers and what is declared on them: (node, is_root, prefix), (child, parent, prefix, override, file, line), (id, node, method, path, framework, file, line).
NODES = [("app", True, "/"), ("api", False, ""), ("items", False, "/items")]
MOUNTS = [("api", "app", "/", False, 20, 2), ("items", "api", "", False, 21, 3), ("items", "app", "/v2", True, 22, 9)]
DECLARED = [
    ("D1", "items", "GET", "/{id}", "FastAPI", 11, 4),
    ("D2", "items", "GET", "/:id/detail", "express", 12, 15),
    ("D3", "app", "PUT", "/orders/<int:id>", "Flask", 13, 6),
    ("D4", "api", "POST", "/users", "express", 14, 2),
    ("D5", "app", "ANY", "/:a/:b?", "express", 55, 30),
]
CHOSEN = ("/users", 30, 3)
BUDGET = 7_000


def _file(number) -> str:
    return f"src/f{number:07d}.js"


# What the composition comes to, as anchored patterns with the places of the mounts.
_ALL = "['GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'HEAD', 'OPTIONS']"
_COMPOSED = f"""pat(route_id, methods, rx, literal_count, file, line, mounts) as (values
  ('D1:/items', ['GET'], '^/items/[^/]+$', 1, '{_file(11)}', 4, [('{_file(20)}', 2), ('{_file(21)}', 3)]),
  ('D1:/v2', ['GET'], '^/v2/[^/]+$', 1, '{_file(11)}', 4, [('{_file(22)}', 9)]),
  ('D2:/items', ['GET', 'HEAD'], '^/items/[^/]+/detail$', 2, '{_file(12)}', 15, [('{_file(20)}', 2), ('{_file(21)}', 3)]),
  ('D2:/v2', ['GET', 'HEAD'], '^/v2/[^/]+/detail$', 2, '{_file(12)}', 15, [('{_file(22)}', 9)]),
  ('D3:/', ['PUT'], '^/orders/[0-9]+$', 1, '{_file(13)}', 6, []),
  ('D4:/', ['POST'], '^/users$', 1, '{_file(14)}', 2, [('{_file(20)}', 2)]),
  ('D5:/', {_ALL}, '^/[^/]+(/[^/]+)?$', 0, '{_file(55)}', 30, []))"""
_EFFECTIVE = """eff as (select *, case
  when origin = 'https://h1.example.test' and (path = '/items' or path like '/items/%') then '/v2' || substr(path, 7)
  when origin = 'https://h2.example.test' then '/gateway' || path else path end as effective_path
 from (select distinct method, 'https://' || host as origin, path from te))"""
_MATCHED = f"{_COMPOSED}, {_EFFECTIVE}, m as (select eff.*, pat.* exclude (methods, rx) from eff join pat on list_contains(methods, method) and regexp_matches(effective_path, rx))"


def composed(spark):
    """The declared routes under every prefix of their router, each with its own id and the trail of its mounts."""
    nodes = spark.createDataFrame(NODES, "node_id string, is_root boolean, prefix string")
    edges = [(c, p, prefix, o, _file(f), n) for c, p, prefix, o, f, n in MOUNTS]
    mounts = spark.createDataFrame(edges, "child string, parent string, prefix string, override boolean, file string, line int")
    rows = [(i, node, method, path, framework, _file(f), n) for i, node, method, path, framework, f, n in DECLARED]
    declared = spark.createDataFrame(rows, "route_id string, node_id string, method string, path string, framework string, file string, line int")
    found = mapping.compose_routes(declared, mapping.mount_prefixes(nodes, mounts)).drop("node_id", "depth")
    named = F.concat("route_id", F.lit(":"), "full_prefix")
    return found.withColumn("ord", F.regexp_extract("route_id", r"(\d+)", 1).cast("long")).withColumn("route_id", named)


def rewritten(spark, sf):
    return mapping.rewrite_paths(mapping.endpoints(fx.te_items(spark, sf)), REWRITES)


# Router prefixes of the composition: "/items" under the api router, "/v2" where the mount overrides it, else the root.
@query("j06_rewritten_routes", f"with {fx.TE}, {_MATCHED} select method, origin, path, effective_path, route_id, literal_count, cast(len(mounts) as int) as n_mounts from m")
def rewritten_routes(spark, sf):
    """Rewrite, then match the composed routes."""
    endpoints, routes = rewritten(spark, sf), composed(spark)
    matches = mapping.match_routes(endpoints, routes).join(routes.select("route_id", F.size("mounts").alias("n_mounts")), "route_id")
    return endpoints.join(matches, "endpoint_id").select("method", "origin", "path", "effective_path", "route_id", "literal_count", "n_mounts")


def _source(secret: str) -> str:
    """A small program per document, in both engines' SQL."""
    return (
        "concat('// head', chr(10), 'function fn', doc_id % 40, '(a) {', chr(10), '  const apiKey = ', chr(34), " + secret + ", chr(34), ';', chr(10), "
        "repeat(concat('  step', doc_id % 7, '(a);', chr(10)), cast(doc_id % 60 as int)), '  return fn', (doc_id * 7 + 3) % 40, '(a);', chr(10), '}')"
    )


_PATH = "concat('src/f', lpad(cast(doc_id as {}), 7, '0'), '.js')"


def source_files(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return docs.select(F.expr(_PATH.format("string")).alias("file"), F.expr(_source("concat('k', doc_id)")).alias("text"))


_STOP = ", ".join(f"'{n}'" for n in names.CALL_STOPWORDS)
_SNIPPET = f"""'S' || left(sha256(r.file || ':' || start), 12) as evidence_id, kind, r.file, line, start, text,
  cast(to_json(struct_pack(id := 'S' || left(sha256(r.file || ':' || start), 12), kind := kind, file := r.file, start := start, "end" := least(len(lines), line + 45), line := line,
   source_hash := hash, reason := reason, truncated := false, text := text)) as varchar) as record
  from (select r.*, hash, lines, array_to_string(list_transform(list_slice(lines, start, line + 45), lambda v, i: (start + i - 1) || ': ' || v), chr(10)) as text
   from {{}} r join f on f.file = r.file) r"""


def _greedy(name: str, rows: str, spent: str) -> str:
    """Greedy selection over numbered rows (e, p, size) of each endpoint, beginning with what was spent."""
    return f"""{name} as (select e, 0 as p, cast({spent} as bigint) as used, false as kept from (select distinct e from {rows})
   union all select t.e, r.p, t.used + case when t.used + size <= {BUDGET} then size else 0 end, t.used + size <= {BUDGET}
   from {name} t join {rows} r on r.e = t.e and r.p = t.p + 1)"""


_ORACLE = f"""with recursive {fx.TI}, {_MATCHED}, g as (select session_tag, 'session-group-' || row_number() over (order by min(idx)) as session_group from ti group by session_tag),
  v as (select method, host, path, status, session_tag, min(idx) as idx from ti group by all),
  sample as (select *, row_number() over (partition by method, host, path order by idx) as rank from v qualify rank <= 3),
  traffic as materialized (select ti.method || ' https://' || ti.host || ti.path as e, [0, rank, 0, 0] as seq, 'T' || left(sha256(slug), 12) as evidence_id, 'traffic' as kind, slug as file, cast(null as int) as line,
   cast(to_json(struct_pack(id := 'T' || left(sha256(slug), 12), kind := 'traffic', file := slug, hash := sha256(request_raw || chr(10) || response_raw), url := url, status := ti.status,
    session_group := session_group, request_headers := {_header_json('request_headers_text')}, request_body := {fx.MASKED_BODY},
    response_headers := {_header_json('response_headers_text')}, response_body := {_TE_RESPONSE})) as varchar) as record
   from sample s join g using (session_tag) join ti on ti.idx = s.idx),
  f as materialized (select {_PATH.format('varchar')} as file, sha256({_source("concat('k', doc_id)")}) as hash, string_split({_source("'[REDACTED]'")}, chr(10)) as lines from documents),
  rk as (select *, row_number() over (partition by method, origin, path order by literal_count desc, file, line, route_id) as rank from m qualify rank <= 6),
  place as (select method || ' ' || origin || path as e, [1, rank, 0, 0] as seq, file, line, 'route' as kind, '{evidence.ROUTE_REASON}' as reason from rk
   union all select method || ' ' || origin || path, [1, rank, n, 0], mounts[n][1], mounts[n][2], 'mount', '{evidence.MOUNT_REASON}' from (select *, unnest(range(1, len(mounts) + 1)) as n from rk)
   union all select distinct method || ' ' || origin || path, [1, 1073741824, 1, 0], '{_file(CHOSEN[1])}', {CHOSEN[2]}, 'analyst-selected', '{evidence.CHOSEN_REASON}' from eff where path = '{CHOSEN[0]}'),
  own as (select *, greatest(1, line - 10) as start from place qualify row_number() over (partition by e, file, start order by seq) = 1),
  src as materialized (select e, seq, {_SNIPPET.format('own')}),
  one as (select e, seq, evidence_id, kind, file, line, record from traffic union all select e, seq, evidence_id, kind, file, line, record from src),
  first as materialized (select *, length(record) as size, row_number() over (partition by e order by seq) as p from one),
  {_greedy('t1', 'first', '0')},
  kept1 as materialized (select first.* from first join t1 using (e, p) where t1.kept),
  calls as (select distinct e, unnest(regexp_extract_all(text, '{names.CALL_PATTERN}', 1)) as name from src semi join kept1 using (e, seq) where kind in ('route', 'mount')),
  decl as (select 'fn' || doc_id % 40 as name, {_PATH.format('varchar')} as file from documents),
  rel as (select e, name, file, 1 as start, row_number() over (partition by e order by file) as rank from calls join decl using (name) where name not in ({_STOP}) qualify rank <= 8),
  wanted as (select e, [2, rank, 0, 0] as seq, file, 2 as line, start, 'related-symbol' as kind,
   '{evidence.DECLARATION_REASON[0]}' || name || '{evidence.DECLARATION_REASON[1]}' as reason from rel anti join src using (e, file, start)),
  more as (select e, seq, {_SNIPPET.format('wanted')}),
  last as materialized (select e, seq, evidence_id, kind, file, line, record, length(record) as size, row_number() over (partition by e order by seq) as p from more),
  {_greedy('t2', 'last', "coalesce((select sum(size) from kept1 where kept1.e = e0.e), 0)").replace('from (select distinct e from last)', 'from (select distinct e from last) e0')},
  kept2 as (select last.* from last join t2 using (e, p) where t2.kept)
  select e as endpoint, cast(row_number() over (partition by e order by seq) as int) as position, evidence_id, kind, file, cast(line as int) as line, size, sha256(record) as record_sha256
  from (select * from kept1 union all select * from kept2)"""


@query("t07_review_evidence", _ORACLE)
def review_evidence(spark, sf):
    """Rewritten endpoints over the traffic, composed routes with their mounts, and a source file per document."""
    endpoints = rewritten(spark, sf)
    path, number, line = CHOSEN
    chosen = endpoints.where(F.col("path") == path).select("endpoint_id", F.lit(_file(number)).alias("file"), F.lit(line).alias("line"))
    found = evidence.review_evidence(fx.te_items(spark, sf), endpoints, composed(spark), source_files(spark, sf), chosen, budget=BUDGET)
    named = endpoints.select("endpoint_id", F.concat("method", F.lit(" "), "origin", "path").alias("endpoint"))
    return found.join(named, "endpoint_id").select(
        "endpoint", "position", "evidence_id", "kind", "file", "line", "size", F.sha2(F.col("record").cast("binary"), 256).alias("record_sha256")
    )


_MASKED_REQUEST = f"""method || ' ' || {fx._TARGET} || ' HTTP/1.1' || chr(13) || chr(10) ||
  replace(regexp_replace(request_headers_text, '(Authorization|Cookie): [^\\n]*', '\\1: [REDACTED]', 'g'), chr(10), chr(13) || chr(10)) || chr(13) || chr(10) || chr(13) || chr(10) || {fx.MASKED_BODY}"""


@query("t07_export_context", f"""with recursive {fx.TI},
  head1 as (select cast(to_json(struct_pack(file := '{context.SUMMARY_FILE}', data := struct_pack(summary := struct_pack(total_items := count(*), unique_hosts := count(distinct host),
    unique_tools := count(distinct tool), unique_endpoints := count(distinct method || ' ' || host || path), unique_sessions := count(distinct session_tag))))) as varchar) as record from ti),
  u as (select * from ti where status like '2%' and user_id % 3 = 0 and user_id % 2 <> 0 order by idx limit 50),
  head2 as (select cast(to_json(struct_pack(file := '{context.FINDINGS_FILE}', data := coalesce(list(struct_pack(category := 'Authentication', severity := 'Medium',
    title := 'Unauthenticated 2xx: ' || {_EP}, detail := 'Endpoint returned success without any auth headers in request.', host := host, items := [slug]) order by idx), []))) as varchar) as record from u),
  heads as (select 1 as p, '{context.SUMMARY_FILE}' as file, record from head1 union all select 2, '{context.FINDINGS_FILE}', record from head2),
  fit as (select *, length(record) + 1 as size, sum(length(record) + 1) over (order by p) as running from heads),
  r as (select idx, slug, cast(to_json(struct_pack(file := slug, data := struct_pack(metadata := struct_pack("index" := idx, tool := tool, time := strftime(time, '%Y-%m-%d %H:%M:%S'), url := url, host := host,
     host_ip := '', port := '443', protocol := 'https', method := method, path := path, extension := '', status := status, response_length := '', mime_type := '', comment := '',
     sha256 := sha256({_MASKED_REQUEST}), session_tag := session_tag),
    request := struct_pack(headers := cast({_header_json('request_headers_text')} as json), body := {fx.MASKED_BODY}),
    response := struct_pack(headers := cast({_header_json('response_headers_text')} as json), body := {_TE_RESPONSE})))) as varchar) as record from ti),
  d as (select *, length(record) + 1 as size, row_number() over (order by slug, idx) as p from r),
  t as (select cast(0 as bigint) as p, (select cast(sum(size) as bigint) from fit where running <= 48000) as used, 0 as n, false as kept
   union all select d.p, t.used + case when t.used + d.size <= 48000 and 48000 - t.used >= 500 and t.n < 50 then d.size else 0 end,
    t.n + case when t.used + d.size <= 48000 and 48000 - t.used >= 500 and t.n < 50 then 1 else 0 end, t.used + d.size <= 48000 and 48000 - t.used >= 500 and t.n < 50
   from t join d on d.p = t.p + 1),
  whole as (select 0 as part, p, file, size, record from fit where running <= 48000 union all select 1, d.p, slug, size, record from d join t using (p) where kept)
  select cast(row_number() over (order by part, p) as int) as position, file, size, record from whole""")
def export_context(spark, sf):
    """Index summary, the first findings and masked items in path order, while they fit."""
    items = fx.te_items(spark, sf)
    return context.export_context(items, findings.row_findings(items, findings.unauthenticated_rule()))

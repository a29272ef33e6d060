"""Route mapping, mounts, imports, evidence and review tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from httploom.functions import names
from httploom.functions import text as tx
from httploom.operators import context, mapping, review

from . import fixtures as fx
from .registry import query

# Route templates over the derived traffic: (id, method, path, framework, file, line).
ROUTES = [
    ("R1", "GET", "/items/{id}", "FastAPI", "app/items.py", 10),
    ("R2", "GET", "/items/:id/detail", "express", "src/items.js", 12),
    ("R3", "ANY", "/items/<int:id>/<tail>", "Flask", "app/flask_items.py", 3),
    ("R4", "PUT", "/orders/<int:id>", "Flask", "app/orders.py", 7),
    ("R5", "POST", "/users", "express", "src/users.js", 4),
    ("R6", "DELETE", "/search", "express", "src/search.js", 9),
    ("R7", "GET", "/:lang/:n?", "express", "src/pages.js", 20),
    ("R8", "GET", "/en/*rest", "express", "src/english.js", 5),
    ("R9", "GET", "/never/{seen}", "FastAPI", "app/never.py", 1),
    ("R10", "GET", "/fr/<uuid:key>", "Flask", "app/french.py", 2),
    ("R11", "GET", "/de/(\\d+)", "express", "src/german.js", 8),
]
_ROUTE_SCHEMA = "route_id string, method string, path string, framework string, file string, line int"
REWRITES = [
    {"origin": "https://h1.example.test", "from": "/items", "to": "/v2/things"},
    {"origin": "https://h1.example.test", "from": "/", "to": "/root"},
    {"origin": "https://h2.example.test", "from": "/items/5", "to": "/five/"},
]


def routes(spark):
    rows = spark.createDataFrame(ROUTES, _ROUTE_SCHEMA)
    return rows.withColumn("ord", F.regexp_extract("route_id", r"(\d+)", 1).cast("long"))


def mapped(spark, sf, items):
    endpoints = mapping.endpoints(items).withColumn("effective_path", F.col("path"))
    return endpoints, mapping.match_routes(endpoints, routes(spark))


# The same templates as anchored patterns, with how specific each is.
_PATTERNS = """pat(route_id, methods, rx, literal_count) as (values
  ('R1', ['GET'], '^/items/[^/]+$', 1), ('R2', ['GET', 'HEAD'], '^/items/[^/]+/detail$', 2),
  ('R3', ['GET', 'POST', 'PUT', 'PATCH', 'DELETE', 'HEAD', 'OPTIONS'], '^/items/[0-9]+/[^/]+$', 1),
  ('R4', ['PUT'], '^/orders/[0-9]+$', 1), ('R5', ['POST'], '^/users$', 1), ('R6', ['DELETE'], '^/search$', 1),
  ('R7', ['GET', 'HEAD'], '^/[^/]+(/[^/]+)?$', 0), ('R8', ['GET', 'HEAD'], '^/en/.+$', 1), ('R9', ['GET'], '^/never/[^/]+$', 1),
  ('R10', ['GET', 'HEAD'], '^/fr/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$', 1))"""
_EP = f"{fx.TE}, ep as (select distinct method, 'https://' || host as origin, path from te)"
_PAGES = f"""{fx.TP}, ep as (select distinct method, protocol || '://' || lower(host) as origin, case when path = '' then '/' else path end as path from tp)"""
_MATCH = f"{_PATTERNS}, m as (select ep.*, route_id, literal_count from ep join pat on list_contains(methods, method) and regexp_matches(case when path = '/' then path else rtrim(path, '/') end, rx))"


def _shown(endpoints, matches, *columns):
    return endpoints.join(matches, "endpoint_id").select("method", "origin", "path", "route_id", *columns)


@query("j05_rewrites", f"""with {_EP} select method, origin, path, case
  when origin = 'https://h2.example.test' and (path = '/items/5' or path like '/items/5/%') then '/five' || substr(path, 9) || case when path = '/items/5' then '/' else '' end
  when origin = 'https://h1.example.test' and (path = '/items' or path like '/items/%') then '/v2/things' || substr(path, 7)
  when origin = 'https://h1.example.test' then '/root' || path else path end as effective_path from ep""")
def rewrites(spark, sf):
    found = mapping.rewrite_paths(mapping.endpoints(fx.te_items(spark, sf)), REWRITES)
    return found.select("method", "origin", "path", "effective_path")


@query("j06_route_matches", f"with {_EP}, {_MATCH} select method, origin, path, route_id, literal_count from m")
def route_matches(spark, sf):
    return _shown(*mapped(spark, sf, fx.te_items(spark, sf)), "literal_count")


@query("j06_route_matches_pages", f"with {_PAGES}, {_MATCH} select method, origin, path, route_id, literal_count from m")
def route_matches_pages(spark, sf):
    return _shown(*mapped(spark, sf, fx.tp_items(spark, sf)), "literal_count")


@query("j07_methods", f"""with {fx.TE}, ep as (select distinct case method when 'GET' then 'HEAD' else method end as method, 'https://' || host as origin, path from te),
  {_MATCH} select method, origin, path, route_id from m""")
def methods(spark, sf):
    """HEAD requests reach GET routes of the frameworks that add HEAD."""
    items = fx.te_items(spark, sf).withColumn("method", F.when(F.col("method") == "GET", F.lit("HEAD")).otherwise(F.col("method")))
    return _shown(*mapped(spark, sf, items))


_STATES = f"""{_MATCH}, c as (select method, origin, path, count(*) as n from m group by all),
  st as (select ep.*, coalesce(n, 0) as match_count, case when n is null then 'unmapped' when n = 1 then 'candidate' else 'ambiguous' end as state
   from ep left join c using (method, origin, path))"""


@query("j08_states", f"with {_PAGES}, {_STATES} select * from st")
def states(spark, sf):
    found = mapping.mapping_states(*mapped(spark, sf, fx.tp_items(spark, sf)))
    return found.select("method", "origin", "path", "match_count", "state")


@query("j09_unobserved", f"with {_PAGES}, {_MATCH} select column0 as route_id from (values {', '.join(repr((r[0],)).replace(',)', ')') for r in ROUTES)}) v(column0) where column0 not in (select route_id from m)")
def unobserved(spark, sf):
    _, matches = mapped(spark, sf, fx.tp_items(spark, sf))
    return mapping.unobserved_routes(routes(spark), matches).select("route_id")


@query("a16_state_counts", f"with {_PAGES}, {_STATES} select state, count(*) as n from st group by state union all select 'unobserved_route', {len(ROUTES)} - (select count(distinct route_id) from m)")
def state_counts(spark, sf):
    endpoints, matches = mapped(spark, sf, fx.tp_items(spark, sf))
    return mapping.state_counts(mapping.mapping_states(endpoints, matches), mapping.unobserved_routes(routes(spark), matches))


_FILES = ", ".join(f"('{r[0]}', '{r[4]}', {r[5]}, {int(r[0][1:])})" for r in ROUTES)


@query("w15_candidates", f"""with {_PAGES}, {_MATCH}, f(route_id, file, line, ord) as (values {_FILES}),
  o as (select m.*, file, line, ord, row_number() over (partition by method, origin, path order by literal_count desc, file, line, ord) as rank from m join f using (route_id))
  select method, origin, path, route_id, cast(rank as int) as rank from o where rank <= 30""")
def candidates(spark, sf):
    endpoints, matches = mapped(spark, sf, fx.tp_items(spark, sf))
    return _shown(endpoints, mapping.ranked_candidates(matches), "rank")


# -- mounts, imports ---------------------------------------------------------
@query("j14_mounts", """with recursive t as (select c_custkey as id, '/n' || c_custkey as full_prefix, 0 as depth, '' as trail from customer where c_custkey = 1
  union all select c.c_custkey, t.full_prefix || '/m' || c.c_custkey || case when c.c_custkey % 5 = 0 then '' else '/n' || c.c_custkey end, depth + 1,
    trail || ' routers' || c.c_nationkey || '.js:' || c.c_custkey % 100
   from t join customer c on c.c_custkey // 2 = t.id and c.c_custkey > 1)
  select id as node_id, full_prefix, depth, ltrim(trail) as trail from t""")
def mounts(spark, sf):
    """A router tree over the customers: parent = key div 2, every fifth mount overrides the child's prefix."""
    keys = fx.table(spark, sf, "customer").where("c_custkey > 0").select(F.col("c_custkey").alias("node_id"), "c_nationkey")
    nodes = keys.select("node_id", (F.col("node_id") == 1).alias("is_root"), F.concat(F.lit("/n"), "node_id").alias("prefix"))
    edges = keys.where("node_id > 1").select(
        F.col("node_id").alias("child"), F.floor(F.col("node_id") / 2).alias("parent"),
        F.concat(F.lit("m"), "node_id", F.lit("/")).alias("prefix"), (F.col("node_id") % 5 == 0).alias("override"),
        F.concat(F.lit("routers"), "c_nationkey", F.lit(".js")).alias("file"), (F.col("node_id") % 100).alias("line"),
    )
    trail = F.array_join(F.transform("trail", lambda m: F.concat(m["file"], F.lit(":"), m["line"])), " ")
    return mapping.mount_prefixes(nodes, edges).withColumn("trail", trail)


@query("j14_composed_routes", """with recursive t as (select c_custkey as id, '/n' || c_custkey as full_prefix, 0 as depth from customer where c_custkey = 1
  union all select c.c_custkey, t.full_prefix || '/n' || c.c_custkey, depth + 1 from t join customer c on c.c_custkey // 2 = t.id and c.c_custkey > 1)
  select id as node_id, full_prefix || '/' || lower(c_mktsegment) as path from t join customer on c_custkey = id""")
def composed_routes(spark, sf):
    customers = fx.table(spark, sf, "customer").where("c_custkey > 0").withColumnRenamed("c_custkey", "node_id")
    nodes = customers.select("node_id", (F.col("node_id") == 1).alias("is_root"), F.concat(F.lit("n"), "node_id", F.lit("/")).alias("prefix"))
    nodes = nodes.withColumn("prefix", F.when(F.col("is_root"), F.lit("/n1")).otherwise(F.col("prefix")))
    edges = customers.where("node_id > 1").select(
        F.col("node_id").alias("child"), F.floor(F.col("node_id") / 2).alias("parent"), F.lit("").alias("prefix"), F.lit(False).alias("override")
    )
    declared = customers.select("node_id", F.lower("c_mktsegment").alias("path"))
    return mapping.compose_routes(declared, mapping.mount_prefixes(nodes, edges)).select("node_id", "path")


@query("j13_imports", """with f as (select doc_id, lang || '/' || source || '/m' || doc_id || case doc_id % 4 when 0 then '.js' when 1 then '.ts' when 2 then '/index.js' else '.py' end as file,
   'pages/' || lang || '/d' || doc_id || '.js' as importer from documents)
  select importer as file, '../../' || regexp_replace(file, '(/index)?[.](js|ts|py)$', '') as spec, file as target from f where doc_id % 10 <> 0""")
def imports(spark, sf):
    """One import per document file; every tenth file is missing."""
    docs = fx.table(spark, sf, "documents")
    base = F.concat("lang", F.lit("/"), "source", F.lit("/m"), "doc_id")
    kind = F.col("doc_id") % 4
    suffix = F.when(kind == 0, F.lit(".js")).when(kind == 1, F.lit(".ts")).when(kind == 2, F.lit("/index.js")).otherwise(F.lit(".py"))
    files = docs.where("doc_id % 10 <> 0").select(F.concat(base, suffix).alias("file"))
    wanted = docs.select(
        F.concat(F.lit("pages/"), "lang", F.lit("/d"), "doc_id", F.lit(".js")).alias("file"),
        F.concat(F.lit("../../"), base).alias("spec"), F.lit(False).alias("is_python"),
    )
    return review.resolve_imports(wanted, files)


@query("j12_related", """with recursive f as (select doc_id, 'src/f' || lpad(cast(doc_id as varchar), 7, '0') || '.js' as file, 'fn' || (doc_id % 40) as name from documents),
  c as (select user_id as u, k from (select distinct user_id, cast(regexp_extract(props, '([0-9]+)', 1) as int) % 40 as k, event_type from events where event_type = 'view')),
  calls as (select distinct 'E' || u as endpoint_id, 'fn' || k as name from c),
  r as (select endpoint_id, name, file, 2 as line, row_number() over (partition by endpoint_id order by file) as rank from calls join f using (name))
  select endpoint_id, name, file, cast(line as int) as line, cast(rank as int) as rank from r where rank <= 8""")
def related(spark, sf):
    """Calls named in events against declarations in document files (40 shared names)."""
    docs = fx.table(spark, sf, "documents")
    files = docs.select(
        F.concat(F.lit("src/f"), F.lpad(F.col("doc_id").cast("string"), 7, "0"), F.lit(".js")).alias("file"),
        F.concat(F.lit("// head\nfunction fn"), (F.col("doc_id") % 40).cast("string"), F.lit("(a) {\n}")).alias("text"),
    )
    views = fx.te(spark, sf).where("method = 'GET' and status = '200'")
    evidence = views.select(
        F.concat(F.lit("E"), "user_id").alias("endpoint_id"),
        F.concat(F.lit("if (x) { return fn"), (F.col("k") % 40).cast("string"), F.lit("(req) } require(y)")).alias("text"),
    )
    return review.related_declarations(evidence, files).select("endpoint_id", "name", "file", "line", "rank")


# -- citations, plans, staleness ---------------------------------------------
@query("j11_citations", f"""with {fx.TI} select idx as finding_id, idx % 7 <> 0 as all_known, idx % 11 <> 0 as cites_traffic from ti""")
def citations(spark, sf):
    """Each item cites itself and one source record; some citations are invented or lack traffic."""
    items = fx.te_items(spark, sf)
    own, other = tx.content_id("T", F.col("slug")), tx.content_id("S", F.col("slug"))
    findings = items.select(
        F.col("index").alias("finding_id"),
        F.array(
            F.when(F.col("index") % 11 == 0, other).otherwise(own), F.when(F.col("index") % 7 == 0, F.lit("S-invented")).otherwise(other)
        ).alias("evidence_ids"),
    )
    evidence = items.select(own.alias("evidence_id"), F.lit("traffic").alias("kind")).unionByName(
        items.select(other.alias("evidence_id"), F.lit("route").alias("kind"))
    )
    return review.citation_check(findings, evidence)


@query("j15_stale", """select 'route' as kind, 'f' || doc_id as file, sha256(text) as stored_hash,
  case when doc_id % 9 = 0 then null else sha256(text || '!') end as current_hash from documents where doc_id % 9 = 0 or doc_id % 4 = 1""")
def stale(spark, sf):
    docs = fx.table(spark, sf, "documents")
    key = [F.lit("route").alias("kind"), F.concat(F.lit("f"), "doc_id").alias("file")]
    stored = docs.select(*key, F.sha2(F.col("text").cast("binary"), 256).alias("hash"))
    changed = F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    current = docs.where("doc_id % 9 <> 0").select(*key, F.sha2(changed.cast("binary"), 256).alias("hash"))
    return review.stale_evidence(stored, current)


@query("j16_test_plan", f"with {_PAGES} select method, path, origin, check_id, 'not-run' as status from ep cross join (select unnest(['AUTHZ-01', 'AUTHZ-02', 'DATA-01']) as check_id)")
def plan(spark, sf):
    endpoints = mapping.endpoints(fx.tp_items(spark, sf))
    planned = review.test_plan(endpoints, "authorization")
    return planned.join(endpoints.select("endpoint_id", "origin"), "endpoint_id").select("method", "path", "origin", "check_id", "status")


@query("j17_attribution", """select 'C' || doc_id as check_id, unnest(['S-' || source, 'S-x' || (doc_id % 3)]) as source_id, unnest([true, doc_id % 3 = 0]) as known from documents""")
def attribution(spark, sf):
    from httploom.sources import exports

    docs = fx.table(spark, sf, "documents")
    checks = docs.select(
        F.concat(F.lit("C"), "doc_id").alias("check_id"),
        F.array(F.concat(F.lit("S-"), "source"), F.concat(F.lit("S-x"), (F.col("doc_id") % 3).cast("string"))).alias("source_ids"),
    )
    sources = docs.select(F.concat(F.lit("S-"), "source").alias("source_id")).distinct().unionByName(
        docs.where("doc_id = 0").select(F.lit("S-x0").alias("source_id"))
    )
    return exports.attribute_checks(checks, sources).select("check_id", "source_id", "known")


# -- excerpts and budgets ----------------------------------------------------
_MASKED_SOURCE = "array_to_string(part, chr(10))"
for _pattern, _mask in ((names.SOURCE_PRIVATE_KEY, "[REDACTED PRIVATE KEY]"), (names.SOURCE_SECRET_LITERAL, r'\1"' + names.MASK + '"'), (names.SECRET_TOKEN, names.MASK)):
    _MASKED_SOURCE = "regexp_replace({}, '{}', '{}', 'g')".format(_MASKED_SOURCE, _pattern.replace("'", "''"), _mask)


# The masks keep no line ends here, since no secret of the documents goes over a line.
@query("w11_excerpts", f"""with d as (select 'f' || doc_id as file, sha256(text) as hash, string_split(text, chr(10)) as lines, doc_id from documents),
  h as (select file, hash, lines, unnest(range(1, len(lines) + 1, 7)) as line from d),
  s as (select file, hash, lines, greatest(1, line - 10) as start, min(line) as line from h group by all),
  x as (select *, list_slice(lines, start, line + 45) as part from s), y as (select *, string_split({_MASKED_SOURCE}, chr(10)) as masked from x),
  n as (select file, hash, start, line, array_to_string(list_transform(masked, lambda v, i: (start + i - 1) || ': ' || v), chr(10)) as text from y)
  select 'S' || left(sha256(file || ':' || start), 12) as evidence_id, 'route' as kind, file, cast(start as int) as start, cast(line as int) as line, hash, false as truncated, text from n""")
def excerpts(spark, sf):
    """A whole excerpt around every seventh line of every document; starts at line 1 collapse into one."""
    files = fx.table(spark, sf, "documents").select(F.concat(F.lit("f"), "doc_id").alias("file"), "text")
    hits = files.select(
        "file", F.explode(F.sequence(F.lit(1), F.size(F.split("text", "\n")), F.lit(7))).alias("line"), F.lit("route").alias("kind")
    )
    return review.excerpts(files, hits)


@query("w08_prefix_budget", """with f as (select doc_id, length(text) as size from documents),
  r as (select doc_id, size, sum(size) over (order by doc_id) as running from f) select doc_id, size, cast(running as bigint) as running from r where running <= 60000""")
def prefix_budget(spark, sf):
    docs = fx.table(spark, sf, "documents")
    return review.prefix_budget(docs, "doc_id", F.length("text")).select("doc_id", "size", "running")


@query("w09_greedy_budget", """with recursive d as (select source || '.' || lang as grp, doc_id, length(text) as size,
   row_number() over (partition by source, lang order by doc_id) as position from documents),
  t as (select grp, position, size, case when size <= 55000 then size else 0 end as used, size <= 55000 as kept from d where position = 1
   union all select d.grp, d.position, d.size, t.used + case when t.used + d.size <= 55000 then d.size else 0 end, t.used + d.size <= 55000
   from t join d on d.grp = t.grp and d.position = t.position + 1)
  select grp, cast(row_number() over (partition by grp order by position) as int) as position, size from t where kept""")
def greedy_budget(spark, sf):
    """Per source and language, over all documents."""
    docs = fx.table(spark, sf, "documents").withColumn("grp", F.concat("source", F.lit("."), "lang"))
    kept = review.within_budget(docs, "grp", ["doc_id"], F.length("text"), 55_000)
    return kept.select("grp", "position", "size")


_QUOTED = lambda text: f"cast(to_json({text}) as varchar)"
# Response texts as masking leaves them: JSON bodies are written anew with a blank after each colon.
_TE_RESPONSE = "case when response_body like '{%' then replace(response_body, ':', ': ') else response_body end"


def _record(slug: str, url: str, request: str, response: str) -> str:
    return (
        f"""'{{"item":"' || {slug} || '","method":"' || method || '","url":"' || {url} || '","status":"' || status || """
        f"""'","request":' || {_QUOTED(request)} || ',"response":' || {_QUOTED(response)} || '}}'"""
    )


@query("t07_item_context", f"""with {fx.TI}, r as (select idx as index, slug, {_record('slug', 'url', fx.MASKED_BODY, _TE_RESPONSE)} as record from ti),
  s as (select *, cast(sum(length(record)) over (order by index) as bigint) as running from r) select * from s where running <= 60000""")
def item_context(spark, sf):
    return context.item_context(fx.te_items(spark, sf)).select("index", "slug", "record", "running")


_MASKED_DOCUMENT = "response_body"
for _pattern, _mask in (
    (r"(?m)^([^:\r\n]*(?:" + names.SECRET_NAME.replace("(?i)", "(?i:") + r"))[^:\r\n]*):[^\S\r\n]*.*$", r"\1: " + names.MASK),
    (names.SECRET_ASSIGNMENT, r"\1" + names.MASK),
    (names.SECRET_TOKEN, names.MASK),
):
    _MASKED_DOCUMENT = "regexp_replace({}, '{}', '{}', 'g')".format(_MASKED_DOCUMENT, _pattern.replace("'", "''"), _mask)
_TD_SLUG = "printf('%04d', idx) || '_GET_docs_' || ((idx - 1) % 100)"


@query("t07_corpus_context", f"""with recursive {fx.TD}, r as (select idx, {_TD_SLUG} as slug, {_record(_TD_SLUG, "''", "''", _MASKED_DOCUMENT)} as record from td),
  d as (select *, length(record) + 1 as size, row_number() over (order by slug, idx) as p from r),
  t as (select p, size, slug, record, case when size <= 48000 then size else 0 end as used, case when size <= 48000 then 1 else 0 end as n, size <= 48000 as kept from d where p = 1
   union all select d.p, d.size, d.slug, d.record, t.used + case when t.used + d.size <= 48000 and 48000 - t.used >= 500 and t.n < 50 then d.size else 0 end,
    t.n + case when t.used + d.size <= 48000 and 48000 - t.used >= 500 and t.n < 50 then 1 else 0 end, t.used + d.size <= 48000 and 48000 - t.used >= 500 and t.n < 50
   from t join d on d.p = t.p + 1)
  select cast(row_number() over (order by p) as int) as position, slug, record, size from t where kept""")
def corpus_context(spark, sf):
    return context.corpus_context(fx.td_items(spark, sf)).select("position", "slug", "record", "size")


def _header_json(text: str) -> str:
    merged = f"regexp_replace({text}, '(Set-Cookie: [^\\n]*)\\nSet-Cookie: [^\\n]*', '\\1')"
    entry = """'"' || split_part(h, ': ', 1) || '":"' || case when split_part(h, ': ', 1) in ('Authorization', 'Cookie', 'Set-Cookie') then '[REDACTED]' else substr(h, instr(h, ': ') + 2) end || '"'"""
    return f"'{{' || array_to_string(list_transform(string_split({merged}, chr(10)), lambda h: {entry}), ',') || '}}'"


@query("w05_sample_records", f"""with {fx.TI}, g as (select session_tag, 'session-group-' || row_number() over (order by min(idx)) as session_group from ti group by session_tag),
  v as (select method, host, path, status, session_tag, min(idx) as idx from ti group by all),
  r as (select *, row_number() over (partition by method, host, path order by idx) as rank from v)
  select ti.idx as index, ti.method, 'https://' || ti.host as origin, ti.path, rank, ti.status, session_group, 'T' || left(sha256(slug), 12) as evidence_id, slug as file,
   sha256(request_raw || chr(10) || response_raw) as hash, url, {_header_json('request_headers_text')} as request_headers, {fx.MASKED_BODY} as request_body,
   {_header_json('response_headers_text')} as response_headers, {_TE_RESPONSE} as response_body
  from r join g using (session_tag) join ti on ti.idx = r.idx where rank <= 3""")
def sample_records(spark, sf):
    return mapping.sample_records(fx.te_items(spark, sf))

"""Assets, vectors, request variants, sources and sinks (T, W10, V, J1-J3, J10, A17, S, K)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from httploom.functions import http
from httploom.operators import assets, findings, ordering, variants, vectors
from httploom.plans import composite
from httploom.session import scratch, stored
from httploom.sinks import items as sink
from httploom.sources import code, exports

from . import finding_queries as fq
from . import fixtures as fx
from .registry import query


# -- assets ------------------------------------------------------------------
def scripts(spark, sf):
    """Two of three pages served as scripts."""
    pages = fx.tp_items(spark, sf)
    return pages.withColumn("mime_type", F.when(F.col("index") % 3 == 0, F.lit("HTML")).otherwise(F.lit("application/javascript")))


_ASSETS = f"""{fx.TP}, b as (select idx, host, url, response_body, regexp_extract(path, '([^/]*)/*$', 1) as last from tp where idx % 3 <> 0 and response_body <> ''),
  n as (select *, regexp_replace(case when last = '' then 'asset_' || idx else last end || '.js', '[^A-Za-z0-9_.-]', '_', 'g') as file_name from b)"""


@query("t01_assets", f"with {_ASSETS} select idx, 'js' as kind, file_name from n")
def client_assets(spark, sf):
    return assets.client_assets(scripts(spark, sf)).select(F.col("index").alias("idx"), "kind", "file_name")


@query("w10_unique_names", f"""with {_ASSETS}, c as (select *, row_number() over (partition by file_name order by idx) - 1 as copy from n)
  select idx, case when copy = 0 then file_name else left(file_name, length(file_name) - 3) || '_' || copy || '.js' end as unique_name from c""")
def unique_names(spark, sf):
    named = assets.unique_names(assets.client_assets(scripts(spark, sf)), bits=5)
    return named.select(F.col("index").alias("idx"), "unique_name")


@query("t02_script_routes", f"""with {fx.TP}, r as (select idx, unnest(list_distinct(regexp_extract_all(response_body, '["''](/[a-zA-Z0-9_\\-\\./]+)["'']', 1))) as route from tp where idx % 3 <> 0)
  select * from r""")
def script_routes(spark, sf):
    found = assets.script_routes(assets.client_assets(scripts(spark, sf)), prefix="/")
    return found.select(F.col("index").alias("idx"), "route")


@query("t03_wasm", f"with {fx.TD} select idx, idx % 4 <> 3 as has_head, 'asm' || left(sha256(cast(idx as varchar)), 8) as module from td where idx % 2 = 1")
def wasm(spark, sf):
    """Odd documents carry a module (with a message head or bare), even ones something else."""
    index = F.col("index")
    module = F.concat(F.lit("\x00asm"), F.substring(F.sha2(index.cast("string"), 256), 1, 8))
    other = F.concat(F.lit("HTTP/1.1 200 OK\r\n\r\nplain"), index.cast("string"))
    data = F.when(index % 2 == 0, other).when(index % 4 == 3, module).otherwise(F.concat(F.lit("HTTP/1.1 200 OK\r\nA: b\r\n\r\n"), module))
    rows = fx.td_items(spark, sf).withColumn("mime_type", F.lit("application/wasm")).withColumn("response_bytes", F.encode(data, "UTF-8"))
    found = assets.wasm_modules(rows)
    return found.select(
        index.alias("idx"), (F.octet_length("module") < F.octet_length("response_bytes")).alias("has_head"),
        F.substring(F.decode("module", "UTF-8"), 2, 100).alias("module"),
    )


# -- vectors -----------------------------------------------------------------
@query("t04_vector_documents", f"""with {fx.TI} select cast(idx as varchar) as id, method, path, host, status, false as truncated,
  '{{"item":"' || slug || '","method":"' || method || '","url":"' || url || '","request":"' || replace({fx.MASKED_BODY}, '"', '\\"') || '","response":"' ||
   case when response_body like '{{%' then replace(replace(response_body, ':', ': '), '"', '\\"') else response_body end || '"}}' as document
  from ti""")
def vector_documents(spark, sf):
    return vectors.documents(fx.te_items(spark, sf))


_NEAREST = """with q as (select embedding as qv from embeddings where vec_id = 7)
  select vec_id as id, label, round({distance}, 6) as distance from embeddings, q order by {distance}, vec_id limit 12"""
_L2 = "list_sum(list_transform(range(1, 65), lambda i: (cast(embedding[i] as double) - cast(qv[i] as double)) * (cast(embedding[i] as double) - cast(qv[i] as double))))"
_COSINE = "list_cosine_distance(list_transform(embedding, lambda x: cast(x as double)), list_transform(qv, lambda x: cast(x as double)))"


def _nearest(spark, sf, metric):
    index = fx.table(spark, sf, "embeddings").withColumnRenamed("vec_id", "id")
    query_vector = index.where("id = 7").select("embedding").scalar()
    return vectors.nearest(index, query_vector, 12, metric).select("id", "label", F.round("distance", 6).alias("distance"))


@query("t05_nearest", _NEAREST.format(distance=_L2))
def nearest(spark, sf):
    return _nearest(spark, sf, "l2")


@query("t05_nearest_cosine", _NEAREST.format(distance=_COSINE))
def nearest_cosine(spark, sf):
    return _nearest(spark, sf, "cosine")


@query("t06_replaced_index", f"with {fx.TD} select cast(idx as varchar) as id, host from td where idx % 2 = 0")
def replaced_index(spark, sf):
    """Two builds published one after the other: readers get the second."""
    rows = fx.td_items(spark, sf).select(F.col("index").cast("string").alias("id"), "host", "index")
    root = scratch(spark, "vector-index")
    sink.publish_build(rows.where("index % 2 = 1").drop("index"), root)
    sink.publish_build(rows.where("index % 2 = 0").drop("index"), root)
    return sink.read_build(spark, root)


# -- findings to items -------------------------------------------------------
def id_findings(spark, sf):
    """Id findings over the traffic, identified by their item."""
    return findings.row_findings(fx.te_items(spark, sf), findings.id_rule()).withColumn("finding_id", F.col("ord"))


_IDF = """idf as (select idx as finding_id, 'Potential IDOR: ' || method || ' ' || path as title, * from ti
   where event_id_path <> '' or query like 'id=%' or request_body <> '')""".replace(
    "event_id_path", "regexp_extract(path, '/([0-9]{1,10})(/|$)', 1)"
)


@query("j01_items_by_slug", f"with {fx.TI}, {_IDF} select finding_id, url, method from idf")
def items_by_slug(spark, sf):
    found = variants.items_by_slug(id_findings(spark, sf), fx.te_items(spark, sf))
    return found.select("finding_id", "item.url", "item.method")


@query("j02_items_by_title", f"""with {fx.TI}, {_IDF}, ep as (select host, method || ' ' || path as endpoint, min(idx) as idx from ti group by all),
  t as (select distinct host, title from idf), b as (select t.host, title, min(ep.idx) as idx from t join ep on ep.host = t.host and contains(title, endpoint) group by all)
  select finding_id, b.idx from idf join b using (host, title)""")
def items_by_title(spark, sf):
    return variants.first_endpoint_in_title(id_findings(spark, sf), fx.te_items(spark, sf)).withColumnRenamed("index", "idx")


@query("j03_first_get", f"""with {fx.TI}, {_IDF}, g as (select host, min(idx) as idx from ti where method = 'GET' group by host) select finding_id, g.idx from idf join g using (host)""")
def first_get(spark, sf):
    return variants.first_get_item(id_findings(spark, sf), fx.te_items(spark, sf)).withColumnRenamed("index", "idx")


@query("j10_values", """with v(category, n, label, value) as (values ('IDOR', 0, 'zero', '0'), ('IDOR', 1, 'one', '1'), ('IDOR', 2, 'negative', '-1'),
   ('Reflected Input (XSS candidate)', 0, 'marker', 'review-marker'), ('Open Redirect', 0, 'external', 'https://example.invalid/'))
  select category, label, count(*) as findings from f join v using (category) group by all""".replace("with v", f"with {fq.ALL}, v").replace("from f join", "from findings join"))
def values(spark, sf):
    found = findings.all_findings(fx.te_items(spark, sf))
    cases = found.select("category", F.explode(variants.values_of(F.col("category"))).alias("v")).select("category", "v.label")
    return cases.groupBy("category", "label").agg(F.count(F.lit(1)).alias("findings"))


# -- variants ----------------------------------------------------------------
_POINTS = f"""{_IDF}, pts as (
   select idf.*, 'path_segment' as injection_type, 'path[2]' as injection_point, split_part(path, '/', 3) as original_value from idf where path like '/items/%' or path like '/orders/%'
   union all select idf.*, 'query_param', 'id', substr(query, 4) from idf where query like 'id=%'
   union all select idf.*, 'json_body', 'user_id', cast(user_id as varchar) from idf where request_body like '{{%')"""


@query("v01_points", f"with {fx.TI}, {_POINTS} select finding_id, injection_type, injection_point, original_value from pts")
def points(spark, sf):
    sourced = variants.with_source_items(id_findings(spark, sf), fx.te_items(spark, sf))
    pointed = variants.with_points(sourced)
    return pointed.select("finding_id", "injection_type", "injection_point", "original_value")


_CASES = f"""{_POINTS}, vals(label, value) as (values ('zero', '0'), ('one', '1'), ('negative', '-1')),
  cs as (select pts.*, label, value from pts cross join vals union all
   select pts.*, 'prev_id', cast(cast(original_value as bigint) - 1 as varchar) from pts union all
   select pts.*, 'next_id', cast(cast(original_value as bigint) + 1 as varchar) from pts),
  built as (select *, case injection_type when 'path_segment' then protocol || '://' || host || regexp_replace(path, '^(/[a-z]+/)[0-9]+', '\\1' || value) || case when query <> '' then '?' || query else '' end
   when 'query_param' then protocol || '://' || host || path || '?id=' || value else url end as new_url,
   case when injection_type = 'json_body' then regexp_replace(request_body, '^.*"token":"(t[0-9]+)".*$', '{{"user_id": ' || value || ', "active": true, "profile": {{"token": "\\1"}}}}') else request_body end as new_body from cs)"""


@query("v02_requests", f"with {fx.TI}, {_CASES} select finding_id, injection_type, label, method, new_url as url, new_body as body from built")
def requests(spark, sf):
    cases = variants.manifest(id_findings(spark, sf), fx.te_items(spark, sf))
    return cases.select("finding_id", "injection_type", "label", "request.method", "request.url", "request.body")


@query("v03_manifest", f"""with {fx.TI}, {_CASES} select 'case_' || finding_id || '_' || injection_point || '_' || label as case_id, 'IDOR' as category, 'High' as severity,
  injection_point, injection_type, original_value, label, value from cs""")
def manifest(spark, sf):
    cases = variants.manifest(id_findings(spark, sf), fx.te_items(spark, sf))
    return cases.select("case_id", "category", "severity", "injection_point", "injection_type", "original_value", "label", "value")


@query("a17_manifest_summary", f"with {fx.TI}, {_CASES} select count(*) as cases, 'IDOR' as categories, (select count(*) from idf) as findings from cs")
def manifest_summary(spark, sf):
    found = id_findings(spark, sf)
    return variants.manifest_summary(found, variants.manifest(found, fx.te_items(spark, sf)))


_MATCHERS = {c: "\n".join(variants.MATCHERS[c]).replace("'", "''") for c in ("IDOR", "CORS Misconfiguration")}
_OWN_TARGET = "path || case when query <> '' then '?' || query else '' end"


@query("v04_templates", f"""with {fx.TI}, t as (
  select idx, 'IDOR' as category, 'Potential IDOR: GET ' || path as title, {_OWN_TARGET} || '|' || regexp_replace(path, '/[0-9]+', '/' || (k + 1)) || case when query <> '' then '?' || query else '' end as targets,
    '{_MATCHERS["IDOR"]}' as matchers, '' as request_headers, slug, host
   from ti where method = 'GET' and (path like '/items/%')
  union all select idx, 'CORS Misconfiguration', 'Wildcard CORS review: GET ' || path, {_OWN_TARGET}, '{_MATCHERS["CORS Misconfiguration"]}', 'Origin: https://example.invalid', slug, host
   from ti where method = 'GET' and k % 10 = 0)
  select idx, category, title || ' (review candidate)' as name, 'info' as severity, targets, matchers, request_headers, 'and' as matchers_condition, slug as source_item, host from t""")
def templates(spark, sf):
    items = fx.te_items(spark, sf)
    found = findings.row_findings(items, findings.id_rule(), findings.cors_rule(), findings.unauthenticated_rule())
    made = variants.review_templates(found.withColumn("finding_id", F.col("ord")), items)
    added = F.array_join(F.transform("request_headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"])), "\n")
    return made.select(
        F.col("finding_id").alias("idx"), "category", "name", "severity", F.array_join("targets", "|").alias("targets"),
        F.array_join("matchers", "\n").alias("matchers"), added.alias("request_headers"), "matchers_condition", "source_item", "host",
    )


# -- sources -----------------------------------------------------------------
def write_xml_export(spark, sf) -> str:
    """`te` messages as an XML export: base64 messages, tool attributes, host attribute."""
    rows = fx.spread(fx.te_messages(spark, sf))
    text = lambda c: F.struct(F.base64(F.encode(c, "UTF-8")).alias("_VALUE"), F.lit("true").alias("_base64"))
    path = scratch(spark, "xml-export")
    (
        rows.select(
            F.col("tool").alias("_tool"), F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"), "url",
            F.struct(F.col("host").alias("_VALUE"), F.lit("192.0.2.1").alias("_ip")).alias("host"), "port", "protocol", "method", "path",
            text("request_raw").alias("request"), "status", text("response_raw").alias("response"), F.col("idx").cast("string").alias("comment"),
        )
        .sortWithinPartitions(F.col("comment").cast("long"))
        .write.format("xml").option("rootTag", 'items toolVersion="9.9" exportTime="2024-02-01"').option("rowTag", "item").option("declaration", "").save(path)
    )
    return path


@query("s01_xml_items", f"""with {fx.TI} select idx, url, host, method, path, status, tool, request_body, response_body, sha256,
  '192.0.2.1' as host_ip, strftime(time, '%Y-%m-%d %H:%M:%S') as time_raw from ti""")
def xml_items(spark, sf):
    items = exports.read_xml(spark, write_xml_export(spark, sf))
    return items.select(
        F.col("comment").cast("long").alias("idx"), "url", "host", "method", "path", "status", "tool", "request_body", "response_body",
        "sha256", "host_ip", "time_raw",
    )


@query("s01_xml_numbering", "select count(*) as items, count(*) as numbers, 1 as first_number, count(*) as last_number, true as in_document_order from events")
def xml_numbering(spark, sf):
    """Numbers run from 1 to n and follow the document order of every file."""
    path = write_xml_export(spark, sf)
    items = exports.read_xml(spark, path, checked=False)
    spans = stored(items.select("index", F.col("comment").cast("long").alias("c")), "spans")  # the files are read once for it
    # Within a file comments rise; files are as many as there are descents plus one.
    pairs = ordering.consecutive_pairs(spans.withColumn("g", F.lit(0)), ["g"], "index", "c")
    descents = pairs.where("dst < src").agg(F.count(F.lit(1)).alias("n")).scalar()
    files = len(spark.read.text(path).inputFiles())
    return spans.agg(
        F.count(F.lit(1)).alias("items"), F.count_distinct("index").alias("numbers"), F.min("index").cast("int").alias("first_number"), F.max("index").alias("last_number")
    ).withColumn("in_document_order", descents < files)


@query("s02_document_check", "select true as all_items, true as all_closed, false as any_entities, '9.9' as tool_version, '2024-02-01' as export_time from events limit 1")
def document_check(spark, sf):
    summary = exports.document_summary(spark, write_xml_export(spark, sf))
    return summary.agg(
        F.bool_and(F.col("root") == "items").alias("all_items"), F.bool_and("closed").alias("all_closed"),
        F.bool_or("has_entities").alias("any_entities"), F.min("tool_version").alias("tool_version"), F.min("export_time").alias("export_time"),
    )


# What is done to the export of each host: nothing, cut before its end, another root, an entity, a message that is no base64.
_DAMAGE = {1: "truncated", 2: "wrong root", 3: "entity", 4: "bad base64"}


def write_host_exports(spark, sf) -> dict[str, str]:
    """An XML document per host of `te`, some of them damaged; their folders by host. Lines are written in order, one task a host."""
    rows = fx.te_messages(spark, sf)
    number = F.regexp_extract("host", r"h(\d+)", 1).cast("int")
    element = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    escaped = lambda c: F.replace(F.col(c), F.lit("&"), F.lit("&amp;"))
    raw = F.base64(F.encode("request_raw", "UTF-8"))
    message = F.when((number == 4) & (F.col("idx") % 3 == 0), F.concat(F.lit("*"), raw)).otherwise(raw)
    item = F.concat(
        F.lit("<item>"), element("url", escaped("url")), element("host", F.col("host")), element("method", F.col("method")), element("path", F.col("path")),
        F.lit('<request base64="true">'), message, F.lit("</request></item>"),
    )
    root = F.when(F.col("n") == 2, F.lit("records")).otherwise(F.lit("items"))
    entity = F.when(F.col("n") == 3, F.lit('<!DOCTYPE items [<!ENTITY x "y">]>\n')).otherwise(F.lit(""))
    hosts = rows.select("host", number.alias("n")).distinct()
    first = hosts.select("host", F.lit(-1).cast("long").alias("at"), F.concat(F.lit('<?xml version="1.0"?>\n'), entity, F.lit("<"), root, F.lit(' toolVersion="9.9">')).alias("value"))
    last = hosts.where("n <> 1").select("host", F.lit(2**62).alias("at"), F.concat(F.lit("</"), root, F.lit(">")).alias("value"))
    lines = rows.select("host", F.col("idx").alias("at"), item.alias("value")).unionByName(first).unionByName(last)
    path = scratch(spark, "host-exports")
    lines.repartition("host").sortWithinPartitions("host", "at").select("host", "value").write.partitionBy("host").text(path)
    return {f"h{n}.example.test": f"{path}/host=h{n}.example.test" for n in range(7)}


@query("s02_damaged_documents", f"""with {fx.TE} select host, case host {' '.join(f"when 'h{n}.example.test' then '{kind}'" for n, kind in _DAMAGE.items())} else '' end as damage,
  case when host in ('h0.example.test', 'h5.example.test', 'h6.example.test') then count(*) end as items from te group by host""")
def damaged_documents(spark, sf):
    """Every damaged document is refused as a whole; the others give all their items."""
    folders = write_host_exports(spark, sf)

    def outcome(host: str) -> tuple:
        damage = _DAMAGE.get(int(host[1]), "")
        try:
            return host, damage, exports.read_xml(spark, folders[host]).agg(F.count(F.lit(1)), F.max("sha256")).first()[0]
        except Exception:
            return host, damage, None

    present = sorted(r[0] for r in fx.te(spark, sf).select("host").distinct().collect())  # seven hosts at most
    return spark.createDataFrame([outcome(host) for host in present], "host string, damage string, items long")


@query("s03_export_meta", "select '9.9' as tool_version, '2024-02-01' as export_time, count(*) > 0 as has_files from events")
def export_meta(spark, sf):
    return exports.export_meta(spark, write_xml_export(spark, sf)).select("tool_version", "export_time", (F.col("files") > 0).alias("has_files"))


@query("s05_item_json", f"""with {fx.TI} select idx, url, tool, status, request_body, response_body, session_tag,
  cast(null as varchar) as reject_reason, len(string_split(request_headers_text, chr(10))) as headers from ti""")
def item_json(spark, sf):
    path = scratch(spark, "item-json")
    sink.nested(fx.te_items(spark, sf)).write.json(path)
    items = exports.read_item_json(spark, path, per_item_files=False)
    return items.select(
        F.col("index").alias("idx"), "url", "tool", "status", "request_body", "response_body", "session_tag", "reject_reason",
        F.size("request_headers").cast("long").alias("headers"),
    )


@query("s09_source_files", """with f as (select doc_id, 'src/' || case doc_id % 5 when 0 then 'node_modules/' when 1 then '.cache/' else '' end || 'm' || doc_id
   || case doc_id % 3 when 0 then '.js' when 1 then '.test.ts' else '.py' end as file, case when doc_id % 7 = 0 then chr(0) else '' end || text as content from documents)
  select file, sha256(content) as hash from f where doc_id % 5 > 1 and doc_id % 3 <> 1 and doc_id % 7 <> 0 and octet_length(encode(content)) <= 300000""")
def source_files(spark, sf):
    doc = F.col("doc_id")
    folder = F.when(doc % 5 == 0, F.lit("node_modules/")).when(doc % 5 == 1, F.lit(".cache/")).otherwise(F.lit(""))
    suffix = F.when(doc % 3 == 0, F.lit(".js")).when(doc % 3 == 1, F.lit(".test.ts")).otherwise(F.lit(".py"))
    content = F.encode(F.concat(F.when(doc % 7 == 0, F.lit("\x00")).otherwise(F.lit("")), "text"), "UTF-8")
    files = fx.table(spark, sf, "documents").select(
        F.concat(F.lit("src/"), folder, F.lit("m"), doc, suffix).alias("file"), content.alias("content")
    )
    return code.indexed_files(files.withColumn("length", F.octet_length("content"))).select("file", "hash")


@query("s10_findings_json", fq.unauth_sql)
def findings_json(spark, sf):
    path = scratch(spark, "findings")
    found = findings.row_findings(fx.te_items(spark, sf), findings.unauthenticated_rule())
    sink.write_artifact(found.drop("rule_order", "ord"), path)
    return fq.shown(exports.read_findings(spark, path).withColumn("rule_order", F.lit(0)))


@query("s11_catalog", "select distinct source || '-' || lang as check_id, 'S-' || source as source_id, 'About ' || source as title from documents")
def catalog(spark, sf):
    """A catalog document built from the documents' sources, written as JSON and read back."""
    docs = fx.table(spark, sf, "documents").select("source", "lang").distinct()
    check = F.struct(
        F.concat_ws("-", "source", "lang").alias("id"), F.lit("t").alias("title"), F.array(F.concat(F.lit("S-"), "source")).alias("sourceIds")
    )
    about = F.struct(F.concat(F.lit("S-"), "source").alias("key"), F.struct(F.concat(F.lit("About "), "source").alias("title")).alias("value"))
    path = scratch(spark, "catalog")
    docs.groupBy().agg(
        F.collect_list(check).alias("checks"), F.map_from_entries(F.array_distinct(F.collect_list(about))).alias("sources")
    ).write.json(path)
    checks, sources = exports.read_catalog(spark, path)
    return exports.attributed_checks(checks, sources).select("check_id", "source_id", "title")


# -- sinks -------------------------------------------------------------------
@query("k01_nested_json", f"""with {fx.TI} select idx, session_tag, request_raw, 'HTTP/1.1 ' || status || ' R' as status_line,
  'h' || (user_id % 7) || '.example.test' as host_header from ti""")
def nested_json(spark, sf):
    path = scratch(spark, "nested")
    sink.nested(fx.te_items(spark, sf)).write.json(path)
    rows = spark.read.schema(exports.ITEM_JSON).json(path)
    return rows.select(
        F.col("metadata.index").alias("idx"), "metadata.session_tag", F.col("request.raw").alias("request_raw"), "response.status_line",
        F.col("request.headers")["Host"].alias("host_header"),
    )


def _layout(name: str, layout: str, columns: list[str], sql: str, include_host: bool = False) -> None:
    """Write a layout, then count rows per directory."""

    @query(name, f"with {fx.TI} select {sql}, count(*) as items from ti group by all")
    def run(spark, sf):
        path = scratch(spark, layout)
        sink.write_items(fx.te_items(spark, sf), path, layout, include_host=include_host)
        # Keep directory names as text: '00' is a minute, not a number.
        spec = ", ".join(f"{c} string" for c in columns)
        rows = spark.read.schema(f"metadata struct<index:long>, {spec}").json(path)
        return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("items"))


_layout("k02_flat", "flat", ["tool_dir"], "tool as tool_dir")
_layout("k03_by_host", "by_host", ["tool_dir", "host_dir"], "tool as tool_dir, host as host_dir")
_layout("k04_host_first", "host_first", ["host_dir", "tool_dir"], "host as host_dir, tool as tool_dir")
_layout("k06_by_session", "by_session", ["session_dir", "tool_dir"], "session_tag as session_dir, tool as tool_dir")


@query("k05_site_map", f"with {fx.TI} select host as host_dir, array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') as node, count(*) as items from ti group by all")
def site_map(spark, sf):
    path = scratch(spark, "site-map")
    sink.write_items(fx.te_items(spark, sf), path, "site_map")
    rows = spark.read.schema("path_segments array<string>, host_dir string").json(path)
    return rows.groupBy("host_dir", F.array_join("path_segments", "/").alias("node")).agg(F.count(F.lit(1)).alias("items"))


@query("k07_by_time", f"""with {fx.TI} select case when idx % 10 = 0 then 'unknown_datetime' else strftime(time, '%Y-%m-%d') end as date,
  case when idx % 10 = 0 then 'unknown_datetime' else strftime(time, '%H') end as hour, host as host_dir, count(*) as items from ti group by all""")
def by_time(spark, sf):
    """Layout keys only: one directory per minute and host is not worth writing for a check."""
    items = fx.te_items(spark, sf).withColumn("time", F.when(F.col("index") % 10 != 0, F.col("time")))
    keyed = items.select(*[c.alias(n) for n, c in sink.layout_columns("by_time", include_host=True).items()])
    return keyed.groupBy("date", "hour", "host_dir").agg(F.count(F.lit(1)).alias("items"))


@query("k08_snapshot", f"""with {fx.TI} select idx as item_index, slug, tool, url, host, status, sha256, request_raw, response_raw,
  '{{"' || replace(replace(replace(response_headers_text, chr(10) || 'Set-Cookie: pref', '\\npref'), ': ', '":"'), chr(10), '","') || '"}}' as response_headers from ti""")
def snapshot(spark, sf):
    """Written twice to the same path: the second snapshot replaces the first."""
    path = scratch(spark, "snapshot")
    sink.write_snapshot(fx.te_items(spark, sf).where("index < 10"), path)
    sink.write_snapshot(fx.te_items(spark, sf), path)
    rows = spark.read.parquet(path)
    assert rows.columns == sink.SNAPSHOT_COLUMNS
    return rows.select("item_index", "slug", "tool", "url", "host", "status", "sha256", "request_raw", "response_raw", "response_headers")


@query("k09_refusals", f"with {fx.TE} select tool, count(*) as kept, true as target_refused, true as empty_refused, true as nothing_left from te group by tool")
def refusals(spark, sf):
    """An existing target and an empty selection are errors; the target keeps its rows, the empty selection leaves no folder."""
    items = fx.te_items(spark, sf)
    path = scratch(spark, "refused")
    sink.write_items(items, path, "flat")

    def refused(df, target, kind):
        try:
            sink.write_items(df, target, "flat")
        except kind:
            return True
        return False

    empty = scratch(spark, "empty")
    outcome = {
        "target_refused": refused(items, path, AnalysisException),
        "empty_refused": refused(items.where("status = 'none'"), empty, ValueError),
        "nothing_left": refused_read(spark, empty),
    }
    kept = spark.read.json(path).groupBy("metadata.tool").agg(F.count(F.lit(1)).alias("kept"))
    return kept.select("tool", "kept", *[F.lit(v).alias(k) for k, v in outcome.items()])


def refused_read(spark, path):
    try:
        spark.read.text(path)
    except AnalysisException:
        return True
    return False


@query("k10_artifacts", f"with {fx.TI} select count(*) as n from ti where status like '2%' and user_id % 3 = 0 and user_id % 2 <> 0")
def artifacts(spark, sf):
    path = scratch(spark, "artifact")
    sink.write_artifact(findings.row_findings(fx.te_items(spark, sf), findings.unauthenticated_rule()), path, "parquet")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("k11_published_build", f"with {fx.TE} select idx from te where idx % 3 <> 1")
def published_build(spark, sf):
    root = scratch(spark, "build")
    rows = fx.te_items(spark, sf).select(F.col("index").alias("idx"))
    sink.publish_build(rows.where("idx % 3 = 1"), root)
    sink.publish_build(rows.where("idx % 3 <> 1"), root)
    return sink.read_build(spark, root)


@query("f10_preset_redacted_sessions", f"""with {fx.TI}, first as (select url, request_raw, response_raw, min(idx) as idx from ti group by all)
  select session_tag as session_dir, count(*) as items from ti join first using (idx) group by session_tag""")
def preset_redacted(spark, sf):
    kept = composite.apply(fx.te_items(spark, sf), composite.preset("redacted", "by_session"))
    session = http.safe_dirname(F.col("session_tag"))
    return kept.groupBy(session.alias("session_dir")).agg(F.count(F.lit(1)).alias("items"))

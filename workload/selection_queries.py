"""Filters, presets, deduplication, reindexing and capture comparison (F, U, S4, S6-S8, A18)."""

from __future__ import annotations

from pyspark.sql import functions as F

from httploom.functions import http
from httploom.operators import dedup, filters, ordering
from httploom.plans import composite

from . import fixtures as fx
from .registry import query

_SLUG = (
    "concat(case when n < 10000 then lpad(cast(n as varchar), 4, '0') else cast(n as varchar) end, '_', method, '_', "
    "trim(left(trim(regexp_replace(regexp_replace(path, '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g'), '_'), 60), '_'))"
)


def _idx(df):
    return df.select(F.col("index").alias("idx"))


@query("f01_tools", f"with {fx.TE} select idx, tool from te where tool in ('proxy', 'scanner')")
def tools(spark, sf):
    kept = filters.by_tools(fx.te_items(spark, sf), "Proxy, SCANNER")
    return kept.select(F.col("index").alias("idx"), "tool")


@query("f02_status", f"with {fx.TE} select idx, status from te where status in ('201', '403') or status like '5%'")
def status(spark, sf):
    kept = filters.by_status(fx.te_items(spark, sf), "201,403,5XX")
    return kept.select(F.col("index").alias("idx"), "status")


@query("f03_time", f"""with {fx.TE} select idx from te
  where idx % 10 = 0 or (time >= timestamp '2024-01-05 06:30:00' and time < timestamp '2024-01-19 00:00:00')""")
def time_range(spark, sf):
    items = fx.te_items(spark, sf).withColumn("time", F.when(F.col("index") % 10 != 0, F.col("time")))
    return _idx(filters.by_time(items, "2024-01-05 06:30", "2024-01-18"))


@query("f04_parameter_name", f"""with {fx.TE} select idx from te
  where query like 'id=%' or request_body like '{{%' or request_body like 'order_id=%' or user_id % 2 = 0""")
def parameter_name(spark, sf):
    return _idx(filters.by_parameter(fx.te_items(spark, sf), name="ID"))


@query("f04_parameter_pair", f"with {fx.TE} select idx from te where request_body like '%password=p1%'")
def parameter_pair(spark, sf):
    return _idx(filters.by_parameter(fx.te_items(spark, sf), name="passw", value="P1"))


@query("f04_parameter_value", f"""with {fx.TE} select idx from te where query = 'id=5' or path like '%/5/%' or path like '%/5'
  or request_body like '%order_id=5&%' or request_body like '%"user_id":5,%'""")
def parameter_value(spark, sf):
    return _idx(filters.by_parameter(fx.te_items(spark, sf), value="5", exact=True))


@query("f05_regex_response", f"""with {fx.TE} select idx from te
  where response_headers_text like '%X-Frame-Options: DENY%' or response_body like '%Internal Server%'""")
def regex_response(spark, sf):
    return _idx(filters.by_regex(fx.te_items(spark, sf), "internal  ?server|x-frame-options: deny", "response"))


@query("f05_regex_body", f"with {fx.TD} select idx from td where regexp_matches(response_body, '(?i)\\b(copyright|licen[cs]e)\\b|oua[a-z]+n')")
def regex_body(spark, sf):
    return _idx(filters.by_regex(fx.td_items(spark, sf), r"\b(copyright|licen[cs]e)\b|oua[a-z]+n", "both"))


@query("f06_scope", f"with {fx.TE} select idx from te where host < 'h4' and path like '/items%'")
def scope(spark, sf):
    items = fx.te_items(spark, sf)
    hosts = fx.te(spark, sf).where(F.col("host") < "h4").select("protocol", F.upper("host").alias("host")).distinct()
    return _idx(filters.in_scope(items, hosts.withColumn("prefix", F.lit("/items"))))


@query("f07_hosts", f"with {fx.TE} select idx, host from te where host in ('h1.example.test', 'h5.example.test')")
def hosts(spark, sf):
    kept = filters.by_hosts(fx.te_items(spark, sf), ["H1.Example.TEST", "h5.example.test"])
    return kept.select(F.col("index").alias("idx"), "host")


@query("f07_selected_hosts", f"""with {fx.TE} select arg_min(case when idx % 2 = 0 then upper(host) else host end, idx) as host
  from te group by lower(host)""")
def selected_hosts(spark, sf):
    items = fx.te_items(spark, sf)
    mixed = F.when(F.col("index") % 2 == 0, F.upper("host")).otherwise(F.col("host"))
    return filters.selected_hosts(items.withColumn("host", mixed))


@query("f08_by_tool_and_host", f"with {fx.TE} select idx from te where tool = 'repeater' and host = 'h2.example.test'")
def tool_and_host(spark, sf):
    return _idx(filters.items_by_host(filters.items_by_tool(fx.te_items(spark, sf), "repeater"), "h2.example.test"))


@query("w16_first_items", f"with {fx.TE} select idx from te")
def first_items(spark, sf):
    """The item limit is off unless a caller asks for it: all items."""
    return _idx(filters.first_items(fx.te_items(spark, sf)))


# -- composite and presets ---------------------------------------------------
_COMPOSITE = f"""with {fx.TI}, kept as (select * from ti where tool in ('proxy', 'intruder') and (status like '2%' or status = '500')),
  first as (select url, request_raw, response_raw, min(idx) as idx from kept group by all),
  timed as (select ti.* from ti join first using (idx) where time >= timestamp '2024-01-03 00:00:00'),
  numbered as (select *, row_number() over (order by idx) as n from timed)"""
_COMPOSITE_SELECTION = composite.Selection(
    tools="proxy,intruder", statuses="2xx,500", dedupe=True, start="2024-01-03", pattern="HTTP/1\\.1", redact=False
)


@query("f09_composite", f"{_COMPOSITE} select n as idx, {_SLUG} as slug, url, session_tag from numbered")
def composite_filter(spark, sf):
    kept = composite.apply(fx.te_items(spark, sf), _COMPOSITE_SELECTION)
    return kept.select(F.col("index").alias("idx"), "slug", "url", "session_tag")


@query("f09_composite_redacted", f"""{_COMPOSITE} select n as idx, session_tag, {fx.MASKED_BODY} as request_body from numbered""")
def composite_redacted(spark, sf):
    """Session buckets survive masking, bodies do not."""
    from dataclasses import replace

    kept = composite.apply(fx.te_items(spark, sf), replace(_COMPOSITE_SELECTION, redact=True))
    return kept.select(F.col("index").alias("idx"), "session_tag", "request_body")


@query("f10_preset_triage", f"""with {fx.TI}, kept as (select * from ti where status in ('401', '403') or status like '5%'),
  first as (select url, request_raw, response_raw, min(idx) as idx from kept group by all)
  select row_number() over (order by ti.idx) as idx, ti.url, ti.status from ti join first using (idx)""")
def preset_triage(spark, sf):
    kept = composite.apply(fx.te_items(spark, sf), composite.preset("triage", "json"))
    return kept.select(F.col("index").alias("idx"), "url", "status")


@query("a18_step_counts", f"""{_COMPOSITE} select 'input' as step, count(*) as items from ti
  union all select 'tool', count(*) from ti where tool in ('proxy', 'intruder')
  union all select 'status', count(*) from kept union all select 'dedupe', count(*) from first
  union all select 'time', count(*) from timed union all select 'pattern', count(*) from timed""")
def step_counts(spark, sf):
    """Counts observed while the filtered result is produced once."""
    observations = {}
    kept = composite.apply(fx.te_items(spark, sf), _COMPOSITE_SELECTION, observations=observations)
    kept.write.format("noop").mode("overwrite").save()
    rows = [(name, observation.get["items"]) for name, observation in observations.items()]
    return spark.createDataFrame(rows, "step string, items long")


# -- dedupe, union, reindex --------------------------------------------------
@query("u01_dedupe", f"with {fx.TD} select min(idx) as idx, host from td group by host, path, response_body")
def dedupe(spark, sf):
    items = fx.td_items(spark, sf)
    url = F.concat(F.lit("https://"), "host", "path")
    return dedup.dedupe(items.withColumn("url", url).withColumn("response_raw", F.col("response_body"))).select(
        F.col("index").alias("idx"), "host"
    )


@query("u01_dedupe_copies", f"with {fx.TD} select min(idx) as idx from td group by response_body")
def dedupe_copies(spark, sf):
    """Exact text copies under one URL."""
    items = fx.td_items(spark, sf).withColumn("response_raw", F.col("response_body"))
    return _idx(dedup.dedupe(items))


_UNION_SOURCE = f"""{fx.TI}, proxy as (select * from ti where tool = 'proxy' or tool = 'repeater'),
  site as (select * from ti where tool = 'intruder' or tool = 'scanner'),
  fresh as (select min(idx) as idx from site where (url, request_raw, response_raw) not in (select (url, request_raw, response_raw) from proxy)
    group by url, request_raw, response_raw),
  both_sources as (select 0 as s, ti.* from proxy ti union all select 1 as s, site.* from site join fresh using (idx))"""


@query("u02_union", f"with {_UNION_SOURCE} select row_number() over (order by s, idx) as idx, tool, url from both_sources")
def union(spark, sf):
    items = fx.te_items(spark, sf)
    combined = dedup.union_captures(filters.by_tools(items, "proxy,repeater"), filters.by_tools(items, "intruder,scanner"))
    return combined.select(F.col("index").alias("idx"), "tool", "url")


@query("s08_capture_union", f"""with {_UNION_SOURCE} select row_number() over (order by s, idx) as idx, host from both_sources
  where host in ('h0.example.test', 'h3.example.test')""")
def capture_union(spark, sf):
    from httploom.sources import captures

    items = fx.te_items(spark, sf)
    combined = captures.collect(
        filters.by_tools(items, "proxy,repeater"), filters.by_tools(items, "intruder,scanner"),
        hosts=["H0.example.test", "h3.example.test"],
    )
    return combined.select(F.col("index").alias("idx"), "host")


@query("u03_reindex", f"with {fx.TE}, t as (select *, row_number() over (order by idx) as n from te where status = '200') select n as idx, {_SLUG} as slug, idx as original from t")
def reindex(spark, sf):
    items = filters.by_status(fx.te_items(spark, sf), "200").withColumn("comment", F.col("index").cast("string"))
    return dedup.reindex(items, bits=9).select(F.col("index").alias("idx"), "slug", F.col("comment").cast("long").alias("original"))


@query("s04_merge", f"with {fx.TE} select row_number() over (order by idx % 2, idx) as idx, idx as original from te")
def merge(spark, sf):
    """Two files, read in order and numbered through."""
    from httploom.sources import captures

    items = fx.te_items(spark, sf).withColumn("comment", F.col("index").cast("string"))
    merged = captures.merge([items.where("index % 2 = 0"), items.where("index % 2 = 1")])
    return merged.select(F.col("index").alias("idx"), F.col("comment").cast("long").alias("original"))


@query("s06_validity", f"""with {fx.TI}, t as (select idx, case when idx % 11 = 0 then 'TRACE' else method end as method,
   case when idx % 13 = 0 then 'ftp://x/' when idx % 17 = 0 then url || repeat('a', 9000) else url end as url from ti)
   select idx, case when method = 'TRACE' then 'Unsupported item schema or method'
    when length(url) > 8192 then 'Traffic URL exceeds the 8192-character limit or is invalid'
    when url like 'ftp%' then 'Non-HTTP URL' end as reject_reason from t""")
def validity(spark, sf):
    items = fx.te_items(spark, sf)
    mixed = items.withColumn("method", F.when(F.col("index") % 11 == 0, F.lit("TRACE")).otherwise(F.col("method"))).withColumn(
        "url",
        F.when(F.col("index") % 13 == 0, F.lit("ftp://x/"))
        .when(F.col("index") % 17 == 0, F.concat("url", F.repeat(F.lit("a"), F.lit(9000))))
        .otherwise(F.col("url")),
    )
    return filters.validity(mixed, max_url=8192).select(F.col("index").alias("idx"), "reject_reason")


@query("s07_coverage", f"with {fx.TE} select count(*) filter (where method <> 'PUT') as indexed, count(*) as declared, count(*) filter (where method <> 'PUT') = count(*) as complete from te")
def coverage(spark, sf):
    from httploom.sources import captures

    items = fx.te_items(spark, sf)
    return captures.coverage(items.where("method <> 'PUT'"), items.agg(F.count(F.lit(1)).alias("total_items")))


@query("u03_group_numbers", f"with {fx.TE} select idx, row_number() over (partition by host order by idx) as n from te")
def group_numbers(spark, sf):
    items = fx.te_items(spark, sf).select("host", F.col("index").alias("idx"))
    return ordering.group_row_number(items, ["host"], "idx", "n", bits=8).select("idx", "n")


# -- comparison --------------------------------------------------------------
_SIDES = f"""{fx.TI}, sides as (select *, method || ' https://' || host || ':443' || path as endpoint,
  time < timestamp '2024-01-16 00:00:00' as base from ti),
  eps as (select endpoint, bool_or(base) as b, bool_or(not base) as c,
   bool_or(base and (user_id % 3 <> 0 or user_id % 2 = 0)) as auth_b, bool_or(not base and (user_id % 3 <> 0 or user_id % 2 = 0)) as auth_c,
   bool_or(not base and status like '2%') as ok_c from sides group by endpoint)"""


def _before_after(spark, sf):
    items = fx.te_items(spark, sf)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    return items.where(F.col("time") < cut), items.where(F.col("time") >= cut)


@query("u04_endpoint_changes", f"with {_SIDES} select endpoint, case when not b then 'new' when not c then 'removed' else 'common' end as change from eps")
def endpoint_changes(spark, sf):
    return dedup.endpoint_changes(*_before_after(spark, sf))


_PARAMETERS = f"""{_SIDES}, params as (
  select endpoint, base, 'query:' || split_part(p, '=', 1) as parameter from (select endpoint, base, unnest(string_split(query, '&')) as p from sides where query <> '')
  union all select endpoint, base, 'json:' || unnest(json_keys(request_body)) from sides where request_body like '{{%'),
  changed as (select endpoint, parameter, bool_or(base) as b, bool_or(not base) as c from params
   where endpoint in (select endpoint from eps where b and c) group by endpoint, parameter having bool_or(base) <> bool_or(not base))"""


def _with_extra_parameters(spark, sf):
    """A few query keys appear only on one side, so that the comparison has something to report."""
    before, after = _before_after(spark, sf)
    return (
        before.withColumn("url", F.when(F.col("url").contains("id="), F.concat("url", F.lit("&old=1"))).otherwise(F.col("url"))),
        after.withColumn("url", F.when(F.col("url").contains("?q="), F.concat("url", F.lit("&new"))).otherwise(F.col("url"))),
    )


_EXTRA = _PARAMETERS.replace(
    "from sides where query <> '')",
    "from (select endpoint, base, case when base and query like 'id=%' then query || '&old=1' when not base and query like 'q=%' then query || '&new' else query end as query from sides) where query <> '')",
)


@query("u05_parameter_changes", f"with {_EXTRA} select endpoint, parameter, case when c then 'new' else 'removed' end as change from changed")
def parameter_changes(spark, sf):
    return dedup.parameter_changes(*_with_extra_parameters(spark, sf))


@query("u06_downgrades", f"with {_SIDES} select endpoint from eps where auth_b and not auth_c and ok_c")
def downgrades(spark, sf):
    return dedup.authorization_downgrades(*_before_after(spark, sf))


@query("u07_capture_diff", f"""with {_EXTRA}
  select case when not b then 'new_endpoint' else 'removed_endpoint' end as change_type, endpoint, '' as parameter from eps where b <> c
  union all select case when c then 'new_parameter' else 'removed_parameter' end, endpoint, parameter from changed
  union all select 'authorization_downgrade', endpoint, '' from eps where auth_b and not auth_c and ok_c""")
def capture_diff(spark, sf):
    return dedup.capture_diff(*_with_extra_parameters(spark, sf))

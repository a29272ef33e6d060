"""Summaries, parameter index, journeys and id flow (A, W, J4, P17, P20-P22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from httploom.functions import http, jsonx
from httploom.operators import journeys, mapping, ordering, parameters, surface

from . import fixtures as fx
from .registry import query

_EP = "method || ' https://' || host || ':443' || path"


@query("a01_summary", f"""with {fx.TI} select count(*) as total_items, count(distinct host) as unique_hosts, count(distinct tool) as unique_tools,
  count(distinct {_EP}) as unique_endpoints, count(distinct session_tag) as unique_sessions from ti""")
def summary(spark, sf):
    return surface.summary(fx.te_items(spark, sf))


@query("a02_breakdown", f"""with {fx.TI} select 'method' as dimension, method as value, count(*) as items from ti group by method
  union all select 'status', status, count(*) from ti group by status
  union all select 'session', session_tag, count(*) from ti group by session_tag
  union all select 'endpoint', {_EP}, count(*) from ti group by {_EP}""")
def breakdown(spark, sf):
    return surface.breakdown(fx.te_items(spark, sf))


@query("a03_observed_names", f"""with {fx.TE}, h as (select unnest(string_split(request_headers_text, chr(10))) as line, 'q' as side from te
   union all select unnest(string_split(response_headers_text, chr(10))), 'r' from te)
  select distinct case side when 'q' then 'auth_header' else 'security_header' end as kind, split_part(line, ':', 1) as name from h
  where (side = 'q' and split_part(line, ':', 1) in ('Authorization', 'Cookie')) or (side = 'r' and line like 'X-%')
  union select 'sensitive_parameter', 'token' from te where idx % 50 = 0""")
def observed_names(spark, sf):
    """Every fiftieth request also carries a secret-named query key."""
    items = fx.te_items(spark, sf)
    keyed = F.concat("url", F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit("token=x"))
    return surface.observed_names(items.withColumn("url", F.when(F.col("index") % 50 == 0, keyed).otherwise(F.col("url"))))


@query("a04_tool_breakdown", f"""with {fx.TE} select tool, count(*) as items, count(distinct host) as unique_hosts,
  string_agg(distinct method, ', ' order by method) as methods from te group by tool""")
def tool_breakdown(spark, sf):
    return surface.tool_breakdown(fx.te_items(spark, sf))


@query("a05_host_summary", f"with {fx.TE} select host, count(*) as items, string_agg(distinct tool, ', ' order by tool) as tools from te group by host")
def host_summary(spark, sf):
    return surface.host_summary(fx.te_items(spark, sf))


@query("a06_site_map", f"""with {fx.TP}, s as (select lower(host) as host, list_filter(string_split(path, '/'), lambda x: x <> '') as segs from tp),
  p as (select host, case when len(segs) = 0 then ['root'] else segs end as segs from s),
  n as (select host, segs, unnest(range(1, len(segs) + 1)) as depth from p)
  select host, array_to_string(list_slice(segs, 1, depth), '/') as node, cast(depth as int) as depth, count(*) as items from n group by all""")
def site_map(spark, sf):
    return surface.site_map(fx.tp_items(spark, sf))


@query("a07_tools", f"with {fx.TE} select distinct tool from te")
def distinct_tools(spark, sf):
    return surface.distinct_tools(fx.te_items(spark, sf))


@query("a07_hosts", f"with {fx.TP} select distinct host from tp")
def distinct_hosts(spark, sf):
    return surface.distinct_hosts(fx.tp_items(spark, sf))


# -- parameters --------------------------------------------------------------
_PR = f"""{fx.TE}, pr as (
  select 'query' as source, split_part(p, '=', 1) as name, url_decode(split_part(p, '=', 2)) as value, idx, method, path, host from (select *, unnest(string_split(query, '&')) as p from te where query <> '')
  union all select 'body_form', split_part(p, '=', 1), split_part(p, '=', 2), idx, method, path, host from (select *, unnest(string_split(request_body, '&')) as p from te where request_body like 'order%')
  union all select 'json_body', unnest(['user_id', 'active', 'profile.token']), unnest([cast(user_id as varchar), 'true', 't' || k]), idx, method, path, host from te where request_body like '{{%'
  union all select 'cookie', unnest(['sid', 'theme']), '(value)', idx, method, path, host from te where user_id % 2 = 0
  union all select 'header', split_part(p, ': ', 1), split_part(p, ': ', 2), idx, method, path, host from (select *, unnest(string_split(request_headers_text, chr(10))) as p from te) where p not like 'Host:%'),
  pk as (select *, lower(name) as key, method || ' ' || path as endpoint from pr)"""
_EXAMPLES = """ex as (select source, key, value, min(idx) as first from pk where value <> '' group by source, key, value),
  rk as (select *, row_number() over (partition by source, key order by first) as rank from ex)"""


def _rows(spark, sf):
    return parameters.parameters(fx.te_items(spark, sf))


@query("a08_parameters", f"""with {_PR}, {_EXAMPLES}, sh as (select source, key, string_agg(value, '|' order by rank) as example_values from rk where rank <= 3 group by all)
  select arg_min(name, idx) as name, source, count(*) as occurrences, any_value(example_values) as example_values,
   count(distinct endpoint) as endpoint_count, count(distinct host) as host_count,
   key in ('password', 'token', 'session', 'authorization', 'auth') or regexp_matches(key, 'password|token|secret|key|auth') as is_sensitive, key
  from pk join sh using (source, key) group by source, key""")
def parameter_index(spark, sf):
    return parameters.index(_rows(spark, sf)).withColumn("example_values", F.array_join("example_values", "|"))


@query("a08_parameter_endpoints", f"with {_PR} select source, key, endpoint, count(*) as occurrences from pk group by source, key, endpoint")
def parameter_endpoints(spark, sf):
    return parameters.endpoints(_rows(spark, sf))


@query("a08_parameter_hosts", f"with {_PR} select source, key, host, count(*) as occurrences from pk group by source, key, host")
def parameter_hosts(spark, sf):
    return parameters.hosts(_rows(spark, sf))


@query("w07_examples", f"with {_PR}, {_EXAMPLES} select source, key, cast(rank as int) as rank, value from rk where rank <= 3")
def examples(spark, sf):
    return parameters.examples(_rows(spark, sf))


@query("w14_sorted_parameters", f"with {_PR} select arg_min(name, idx) as name, source, count(*) as occurrences from pk group by source, key")
def sorted_parameters(spark, sf):
    return parameters.sorted_index(parameters.index(_rows(spark, sf))).select("name", "source", "occurrences")


@query("a08_summary", f"with {_PR}, u as (select distinct source, key from pk) select coalesce(source, 'all') as source, count(*) as parameters from u group by rollup(source)")
def parameter_summary(spark, sf):
    return parameters.summary(fx.te_items(spark, sf), parameters.index(_rows(spark, sf)))


@query("p17_cookies", f"with {fx.TE} select idx, unnest(['sid', 'theme']) as name, unnest(['s' || user_id, 'dark']) as value from te where user_id % 2 = 0")
def cookies(spark, sf):
    items = fx.te_items(spark, sf)
    return items.select(F.col("index").alias("idx"), F.inline(http.cookie_pairs(F.col("request_headers"))))


@query("p20_flatten", f"""with {fx.TE} select idx, unnest(['user_id', 'active', 'profile.token']) as name,
  unnest([cast(user_id as varchar), 'true', 't' || k]) as value from te where request_body like '{{%'""")
def flatten(spark, sf):
    items = fx.te_items(spark, sf)
    return items.select(F.col("index").alias("idx"), F.inline(jsonx.flatten(F.col("request_body"))))


@query("p21_api_schema", f"""with {fx.TE} select idx, case when request_body like '{{%' then '{{"type": "object", "properties": {{"user_id": {{"type": "integer"}}, "active": {{"type": "boolean"}}, "profile": {{"type": "object", "properties": {{"token": {{"type": "string"}}}}}}}}}}' end as body_schema
  from te""")
def api_schema(spark, sf):
    items = fx.te_items(spark, sf)
    return items.select(F.col("index").alias("idx"), jsonx.api_schema(F.col("request_body")).alias("body_schema"))


@query("p22_sensitive_names", f"""with {_PR} select name, count(*) as n, lower(name) in ('password', 'passwd', 'token', 'secret', 'api_key', 'apikey', 'access_token',
  'refresh_token', 'session', 'sessionid', 'csrf', 'xsrf', 'ssn', 'credit_card', 'cc', 'cvv', 'authorization', 'auth', 'private_key')
  or regexp_matches(lower(name), 'password|token|secret|key|auth') as is_sensitive from pk group by name""")
def sensitive_names(spark, sf):
    return _rows(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "is_sensitive", http.is_sensitive_name(F.col("name"))
    )


# -- API description ---------------------------------------------------------
@query("a12_api_operations", f"""with {fx.TE} select path, lower(method) as method, string_agg(distinct status, ',' order by status) as statuses,
  case when path = '/users' then '{{"type": "object", "properties": {{"user_id": {{"type": "integer"}}, "active": {{"type": "boolean"}}, "profile": {{"type": "object", "properties": {{"token": {{"type": "string"}}}}}}}}}}' end as body_schema
  from te group by path, lower(method)""")
def api_operations(spark, sf):
    return surface.api_operations(fx.te_items(spark, sf)).withColumn("statuses", F.array_join("statuses", ","))


@query("a12_api_parameters", f"""with {fx.TE}, q as (select *, unnest(string_split(query, '&')) as p from te where query <> '')
  select distinct path, lower(method) as method, split_part(p, '=', 1) as name from q""")
def api_parameters(spark, sf):
    return surface.api_parameters(fx.te_items(spark, sf))


@query("a12_api_servers", f"with {fx.TP} select distinct protocol || '://' || host as server from tp")
def api_servers(spark, sf):
    return surface.api_servers(fx.tp_items(spark, sf))


@query("a14_corpus_totals", f"with {fx.TE} select count(*) as items, count(distinct method || ' ' || path) as endpoints, count(distinct host) as hosts from te")
def corpus_totals(spark, sf):
    return surface.corpus_totals(fx.te_items(spark, sf))


@query("a14_corpus_samples", f"""with {fx.TE}, e as (select *, method || ' ' || path as ep, user_id % 3 <> 0 or user_id % 2 = 0 as auth from te),
  d as (select distinct auth, ep from e), r as (select auth, ep, row_number() over (partition by auth order by ep) as rank from d),
  x as (select ep || ' [' || status || ']' as value, row_number() over (order by idx) as rank from e where status like '4%' or status like '5%')
  select case when auth then 'auth_endpoint' else 'noauth_endpoint' end as section, rank, ep as value from r where rank <= 5
  union all select 'error', rank, value from x where rank <= 5 union all select distinct 'status', 0, status from e""")
def corpus_samples(spark, sf):
    return surface.corpus_samples(fx.te_items(spark, sf))


@query("w13_top_endpoints", f"with {fx.TE}, c as (select {_EP} as endpoint, count(*) as items, min(idx) as first from te group by 1) select endpoint, items from c order by items desc, first limit 200")
def top_endpoints(spark, sf):
    return surface.top_endpoints(fx.te_items(spark, sf))


# -- endpoints and samples ---------------------------------------------------
@query("a15_endpoints", f"""with {fx.TI} select 'E' || row_number() over (order by min(idx)) as endpoint_id, method, 'https://' || host as origin, path, count(*) as captures,
  count(distinct (status, session_tag)) as variants from ti group by method, host, path""")
def endpoints(spark, sf):
    found = mapping.endpoints(fx.te_items(spark, sf), bits=10)
    return found.select("endpoint_id", "method", "origin", "path", "captures", "variants")


_GROUPS = "g as (select session_tag, 'session-group-' || row_number() over (order by min(idx)) as session_group from ti group by session_tag)"


@query("w06_session_groups", f"with {fx.TI}, {_GROUPS} select * from g")
def session_groups(spark, sf):
    return mapping.session_groups(fx.te_items(spark, sf), bits=6).drop("session")


@query("w05_samples", f"""with {fx.TI}, {_GROUPS}, v as (select method, host, path, status, session_tag, min(idx) as idx from ti group by all),
  r as (select *, row_number() over (partition by method, host, path order by idx) as rank from v)
  select method, 'https://' || host as origin, path, rank, status, session_group, idx from r join g using (session_tag) where rank <= 3""")
def samples(spark, sf):
    return mapping.samples(fx.te_items(spark, sf)).withColumnRenamed("index", "idx")


# -- journeys and id flow ----------------------------------------------------
_GENERAL = "regexp_replace(method || ' ' || path, '/[0-9]+', '/{id}', 'g')"
_STEPS = f"""{fx.TI}, st as (select {_GENERAL} as src, lead({_GENERAL}) over (partition by host, session_tag order by idx) as dst from ti),
  tr as (select src, dst, count(*) as transitions from st where dst is not null and src <> dst group by all)"""


@query("w01_transitions", f"with {_STEPS} select * from tr")
def transitions(spark, sf):
    return journeys.transitions(fx.te_items(spark, sf), bits=9)


@query("w01_conversation_roles", """with st as (select role as src, lead(role) over (partition by conv_id order by turn) as dst from conversations)
  select src, dst, count(*) as transitions from st where dst is not null group by all""")
def conversation_roles(spark, sf):
    turns = fx.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("index"), "role")
    pairs = ordering.consecutive_pairs(turns, ["conv_id"], "index", "role", bits=2)
    return pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("transitions"))


@query("w02_noise", f"with {_STEPS} select * from tr where transitions >= 2")
def noise(spark, sf):
    return journeys.drop_noise(journeys.transitions(fx.te_items(spark, sf)))


@query("w03_top_transitions", f"with {_STEPS} select * from tr order by transitions desc, src, dst limit 50")
def top_transitions(spark, sf):
    return journeys.top_transitions(journeys.transitions(fx.te_items(spark, sf)))


_FLOW = f"""{fx.TI}, rv as (select host, session_tag, idx, method || ' ' || path as endpoint,
   case when response_body like '{{"item_id"%' then cast(k + 1 as varchar) when response_body like '{{"order_id"%' then cast(k as varchar) end as value from ti),
  src as (select host, session_tag, value, min(idx) as source_item, arg_min(endpoint, idx) as source_endpoint from rv where value is not null group by all),
  use as (select host, session_tag, idx as target_item, method || ' ' || path as target_endpoint, 'path_param' as target_context, unnest(string_split(path, '/')) as value from ti
   union all select host, session_tag, idx, method || ' ' || path, 'query:' || split_part(p, '=', 1), url_decode(split_part(p, '=', 2)) from (select *, unnest(string_split(query, '&')) as p from ti where query <> '')
   union all select host, session_tag, idx, method || ' ' || path, 'body_json', cast(user_id as varchar) from ti where request_body like '{{%'),
  edges as (select value, source_item, source_endpoint, target_item, target_endpoint, target_context from use join src using (host, session_tag, value) where source_item < target_item)"""


@query("w04_first_values", f"with {_FLOW} select * from src")
def first_values(spark, sf):
    return journeys.response_values(fx.te_items(spark, sf)).drop("session")


@query("j04_id_flow", f"with {_FLOW} select * from edges")
def id_flow(spark, sf):
    return journeys.id_flow(fx.te_items(spark, sf), hot_rows=200)


@query("j04_endpoint_flow", f"""with {_FLOW}, g as (select distinct regexp_replace(source_endpoint, '/[0-9]+', '/{{id}}', 'g') as source,
  regexp_replace(target_endpoint, '/[0-9]+', '/{{id}}', 'g') as target from edges) select * from g where source <> target""")
def endpoint_flow(spark, sf):
    return journeys.endpoint_flow(journeys.id_flow(fx.te_items(spark, sf)))

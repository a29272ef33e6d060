"""Traffic views derived from the provided tables; one text per column, accepted by both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from httploom.functions import http
from httploom.schema import ITEMS, conform
from httploom.session import configure, scratch

TE_COLUMNS = {
    "idx": "event_id + 1",
    "time": "ts",
    "tool": "case event_id % 4 when 0 then 'proxy' when 1 then 'repeater' when 2 then 'intruder' else 'scanner' end",
    "protocol": "'https'",
    "host": "concat('h', user_id % 7, '.example.test')",
    "port": "'443'",
    "method": "case event_type when 'view' then 'GET' when 'click' then 'GET' when 'signup' then 'POST' when 'purchase' then 'PUT' else 'DELETE' end",
    "path": "case event_type when 'view' then concat('/items/', k) when 'click' then concat('/items/', k, '/detail') when 'signup' then '/users' when 'purchase' then concat('/orders/', k) else '/search' end",
    "query": "case event_type when 'view' then concat('id=', k) when 'error' then concat('q=term', k, '&redirect=https%3A%2F%2Fexample.invalid') else '' end",
    "status": "case event_type when 'view' then '200' when 'click' then '304' when 'signup' then '201' when 'purchase' then case when k % 5 = 0 then '403' else '200' end else '500' end",
    "request_headers_text": "concat('Host: h', user_id % 7, '.example.test', case when user_id % 3 <> 0 then concat(chr(10), 'Authorization: Bearer u', user_id) else '' end, case when user_id % 2 = 0 then concat(chr(10), 'Cookie: sid=s', user_id, '; theme=dark') else '' end, chr(10), 'X-Trace: t', event_id % 50)",
    "request_body": """case event_type when 'signup' then concat('{"user_id":', user_id, ',"active":true,"profile":{"token":"t', k, '"}}') when 'purchase' then concat('order_id=', k, '&qty=2&password=p', k) else '' end""",
    "response_headers_text": "concat('Content-Type: application/json', case when event_type = 'view' then concat(chr(10), 'X-Frame-Options: DENY') else '' end, case when event_type = 'signup' then concat(chr(10), 'Set-Cookie: sid=s', user_id, '; Secure', chr(10), 'Set-Cookie: pref=1; HttpOnly; SameSite=Lax') else '' end, case when k % 10 = 0 then concat(chr(10), 'Access-Control-Allow-Origin: *') else '' end)",
    "response_body": """case event_type when 'view' then concat('{"item_id":', k + 1, '}') when 'purchase' then concat('{"order_id":', k, '}') when 'error' then concat('term', k, ' Internal Server Error') else '' end""",
    "user_id": "user_id",
    "k": "k",
}
TP_COLUMNS = {
    "idx": "page_id + 1",
    "tool": "'target'",
    "protocol": "split_part(url, '://', 1)",
    "host": "regexp_extract(url, '://([^/?#]+)', 1)",
    "path": "regexp_extract(url, '://[^/?#]+([^?#]*)', 1)",
    "query": "regexp_extract(url, '[?]([^#]*)', 1)",
    "method": "'GET'",
    "status": "case when page_id % 9 = 0 then '404' else '200' end",
    "mime_type": "'HTML'",
    "url": "url",
    "response_body": "html",
}
TD_COLUMNS = {
    "idx": "doc_id + 1",
    "tool": "'proxy'",
    "host": "concat(source, '.', lang, '.example.test')",
    "method": "'GET'",
    "path": "concat('/docs/', doc_id % 100)",
    "status": "'200'",
    "mime_type": "'text'",
    "response_body": "text",
}
# Message texts built from a `te` row; `crlf` is the two-character line end.
_TARGET = "concat(path, case when query <> '' then concat('?', query) else '' end)"
_CRLF = "concat(chr(13), chr(10))"
TI_COLUMNS = {
    "url": f"concat(protocol, '://', host, {_TARGET})",
    "request_raw": f"concat(method, ' ', {_TARGET}, ' HTTP/1.1', {_CRLF}, replace(request_headers_text, chr(10), {_CRLF}), {_CRLF}, {_CRLF}, request_body)",
    "response_raw": f"concat('HTTP/1.1 ', status, ' R', {_CRLF}, replace(response_headers_text, chr(10), {_CRLF}), {_CRLF}, {_CRLF}, response_body)",
}


def _select(columns: dict[str, str]) -> str:
    return ",\n ".join(f"{text} as {name}" for name, text in columns.items())


_K = "cast(regexp_extract(props, '([0-9]+)', 1) as int) as k"
_SAFE = "regexp_replace(regexp_replace(path, '[^A-Za-z0-9_.-]', '_', 'g'), '_+', '_', 'g')"
_TAG_SOURCE = (
    "concat_ws('|', case when user_id % 3 <> 0 then concat('authorization:Bearer u', user_id) end, "
    "case when user_id % 2 = 0 then concat('cookie:sid=s', user_id, '; theme=dark') end)"
)
# Oracle-engine CTEs: `ti` adds message texts, hash, slug and session tag to `te`.
TE = f"te as (select {_select(TE_COLUMNS)} from (select *, {_K} from events))"
TI = (
    f"{TE}, ti0 as (select *, {_select(TI_COLUMNS)} from te), "
    "ti as (select *, sha256(request_raw) as sha256, "
    "concat(case when idx < 10000 then lpad(cast(idx as varchar), 4, '0') else cast(idx as varchar) end, "
    f"'_', method, '_', trim(left(trim({_SAFE}, '_'), 60), '_')) as slug, "
    f"case when user_id % 3 = 0 and user_id % 2 <> 0 then 'session_anon' else concat('session_', left(sha256({_TAG_SOURCE}), 8)) end as session_tag "
    "from ti0)"
)
# A `te` request body with its secrets masked, as the oracle engine spells it.
MASKED_BODY = (
    """case when request_body like '{%' then '{"user_id": ' || user_id || ', "active": true, "profile": {"token": "[REDACTED]"}}' """
    """else regexp_replace(request_body, '(password=)[^&]+', '\\1[REDACTED]') end"""
)
TP = f"tp as (select {_select(TP_COLUMNS)} from pages)"
TD = f"td as (select {_select(TD_COLUMNS)} from documents)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASK_ROWS = 100_000


def spread(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Use every core, and tasks of ``task_rows`` rows at most; inputs with enough splits are left alone. Rows are counted from file footers."""
    width = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // task_rows))
    return df.repartition(width) if df.rdd.getNumPartitions() < width else df


def _view(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(text).alias(name) for name, text in columns.items()])


def _te_of(events: DataFrame) -> DataFrame:
    return _view(events.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int")), TE_COLUMNS)


def te(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _te_of(table(spark, sf_dir, "events"))


_STORED: dict[tuple[str, str, str], str] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Normalise once, keep the items as a table in the shared folder, let every analysis read that table."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = scratch(spark, name)
        build(spark, sf_dir).write.parquet(path)
        _STORED[key] = path
    return spark.read.schema(ITEMS).parquet(_STORED[key])


def _messages_of(rows: DataFrame) -> DataFrame:
    return rows.select("*", *[F.expr(text).alias(name) for name, text in TI_COLUMNS.items()])


def te_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`te` rows with their raw request and response text."""
    return _messages_of(te(spark, sf_dir))


def build_te_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow events are dealt over the tasks, so that every task writes its own messages."""
    events = spread(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props"))
    return normalise(_messages_of(_te_of(events)).withColumnRenamed("idx", "index"))


def te_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`te` as full items: raw messages, parsed headers, hash, slug and session tag."""
    return stored(spark, sf_dir, "te_items", build_te_items)


def normalise(rows: DataFrame) -> DataFrame:
    """Derive the parsed fields of items from raw messages."""
    request, response = F.col("request_raw"), F.col("response_raw")
    parsed = rows.withColumns(
        {
            "request_headers": http.headers_of(request),
            "request_body": http.body(request),
            "response_headers": http.headers_of(response),
            "response_status_line": http.first_line(response),
            "response_body": http.body(response),
            "sha256": F.sha2(request.cast("binary"), 256),
            "slug": http.slug(F.col("index"), F.col("method"), F.col("path")),
            "time_raw": F.date_format("time", "yyyy-MM-dd HH:mm:ss"),
        }
    )
    tagged = parsed.withColumn("session_tag", http.session_tag(F.col("request_headers"), F.col("url")))
    return conform(tagged)


def tp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "pages"), TP_COLUMNS)


def build_tp_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(tp(spark, sf_dir)).withColumnRenamed("idx", "index")
    return conform(rows.withColumn("slug", http.slug(F.col("index"), F.col("method"), F.col("path"))))


def tp_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "tp_items", build_tp_items)


def td(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(table(spark, sf_dir, "documents"), TD_COLUMNS)


def build_td_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(td(spark, sf_dir)).withColumnRenamed("idx", "index")
    return conform(rows.withColumn("slug", http.slug(F.col("index"), F.col("method"), F.col("path"))))


def td_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "td_items", build_td_items)

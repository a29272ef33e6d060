"""XML and JSON item exports, findings and catalogs as DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import http, urls
from ..functions import text as tx
from ..operators import filters, ordering
from ..schema import conform
from ..session import stored

_TEXT = T.StringType()


def _with_attribute(attribute: str) -> T.StructType:
    return T.StructType([T.StructField("_VALUE", _TEXT), T.StructField(attribute, _TEXT)])


XML_ITEM = T.StructType(
    [
        T.StructField("_tool", _TEXT),
        *[T.StructField(n, _TEXT) for n in ("time", "url", "port", "protocol", "method", "path", "extension", "status")],
        *[T.StructField(n, _TEXT) for n in ("responselength", "mimetype", "comment")],
        T.StructField("host", _with_attribute("_ip")),
        T.StructField("request", _with_attribute("_base64")),
        T.StructField("response", _with_attribute("_base64")),
    ]
)


TAIL = 1 << 16


# -- XML ---------------------------------------------------------------------
def read_xml(spark: SparkSession, path: str | list[str], checked: bool = True) -> DataFrame:
    """Items of one or more XML exports, numbered through in file-name and document order.

    Malformed documents fail the read; nothing partial comes back.
    """
    documents = stored(_documents(spark, path), "documents")
    if checked:
        _refuse_bad(documents)
    plain, whole = _by_reader(documents, path)
    rows = []
    if plain is not None:
        value = F.col("value")
        items = _chunks(spark, plain).where(~F.ltrim(value, F.lit(tx.WHITESPACE)).startswith("</items"))
        # Only the first item of a file has more than blanks before it.
        item = F.when(value.contains("<items"), F.regexp_extract(value, _ITEM, 1)).otherwise(value)
        parsed = F.from_xml(F.concat(item, F.lit(_ITEM_END)), XML_ITEM, _XML_OPTIONS)
        rows.append(items.select(parsed.alias("_x"), "_file", "_block", "_at").select("_x.*", "_file", "_block", "_at"))
    if whole is not None:
        rows.append(
            spark.read.format("xml")
            .options(rowTag="item", **_XML_OPTIONS)
            .schema(XML_ITEM)
            .load(whole)
            .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
            .withColumn("_at", F.monotonically_increasing_id())  # rises within a block
        )
    return from_xml_rows(number_by_block(reduce(DataFrame.unionByName, rows)))


_XML_OPTIONS = {"mode": "FAILFAST", "ignoreSurroundingSpaces": "false"}
_ITEM_END = "</item>"
# A chunk is what stands before an item's end tag, or after the last one. What may stand before an item of a plain document:
# blanks; before the first one, declaration, document type and root tag.
_HEAD = r"\uFEFF?\s*(?:<\?xml[^<>]*\?>)?\s*(?:<!DOCTYPE[^<>\[\]]*(?:\[(?:\s++|<!(?:ELEMENT|ATTLIST)[^<>]*>)*+\])?\s*>)?\s*<items(?:\s(?:[^<>]*[^<>/])?)?>"
_ITEM = rf"(?s)\A(?:{_HEAD})?\s*(<item(?:\s(?:[^<>]*[^<>/])?)?>.*)\z"
_OPENED = r"\A<item(?:\s(?:[^<]*[^</])?)?\z"
_CDATA = r"(?s)<!\[CDATA\[.*?\]\]>"
# What the end tag alone does not cut rightly: items in items or without an end tag of this spelling, comments, open sections.
_ODD = ("<item", "</item", "<!--", "<![CDATA[", "]]>", "<?")


def _chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Texts between the end tags of items with file, block and place: a long file is read by many tasks."""
    return (
        spark.read.option("lineSep", _ITEM_END)
        .text(path)
        .select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        .withColumn("_at", F.monotonically_increasing_id())
    )


def _documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per XML file its root element and tag, whether it is closed, declares entities, and is plain; one pass over the chunks.

    The first chunk of a plain file holds the root tag, the last one closes it, all others are an item after blanks, so that items are
    told by their end tags alone. A file with comments, sections that hold an end tag, items without content and the like is not
    plain; neither is a damaged one. Patterns are tried on few or short texts only.
    """
    value = F.col("value")
    text = F.ltrim(value, F.lit(tx.WHITESPACE))  # stripping both ends would walk through every text
    rooted, begun = value.contains("<items"), text.startswith("<item") & ~text.startswith("<items")
    first = F.when((F.col("_block") == 0) & ~text.startswith("</items"), F.when(begun, F.substring(text, 1, 256)).otherwise(value))
    head = F.when(rooted, value.rlike(rf"\A{_HEAD}")).otherwise(F.lit(False))
    tail = F.when(text.startswith("</items"), text.rlike(r"\A</items\s*>\s*\z")).otherwise(F.lit(False))
    item = F.when(rooted, F.regexp_extract(value, _ITEM, 1)).otherwise(text)
    section = F.col("item").contains("<![CDATA[")
    inner = F.substring(F.when(section, F.regexp_replace("item", _CDATA, "")).otherwise(F.col("item")), 6, 1 << 30)
    odd = reduce(lambda a, b: a | b, [inner.contains(sign) for sign in _ODD])
    opened = tx.before(F.col("item"), ">").rlike(_OPENED) & F.col("item").contains(">")
    element = lambda c: F.nullif(F.regexp_extract(c, r"<([A-Za-z][\w.\-]*)", 1), F.lit(""))
    end = F.substring(value, -TAIL, TAIL).rlike(r"(?:</items\s*>|<items\b[^>]*/>)\s*(?:<!--.*-->\s*)?$")
    kinds = _chunks(spark, path).withColumn("item", item).select(
        "_file", "_block", "_at", head.alias("head"), tail.alias("tail"), (tail | (opened & ~odd)).alias("known"),
        element(first).alias("root"), F.when(rooted, F.nullif(F.regexp_extract(first, r"(<items\b[^>]*>?)", 1), F.lit(""))).alias("root_tag"),
        F.when(F.col("_block") == 0, tx.before(value, "<items").contains("<!ENTITY")).alias("entity"), (text != "").alias("shown"),
        F.when(rooted | value.contains("</items"), end).otherwise(F.lit(False)).alias("end"),
    )
    where = lambda c: F.when(c, F.col("_at"))
    blocks = kinds.groupBy("_file", "_block").agg(
        F.min("_at").alias("first"), F.max("_at").alias("last"), F.bool_and("known").alias("known"),
        F.count_if("head").alias("heads"), F.count_if("tail").alias("tails"),
        F.min(where(F.col("head"))).alias("head_at"), F.max(where(F.col("tail"))).alias("tail_at"),
        F.min_by("root", where(F.col("root").isNotNull())).alias("root"), F.min_by("root_tag", where(F.col("root_tag").isNotNull())).alias("root_tag"),
        F.min(where(F.col("root_tag").isNotNull())).alias("root_at"), F.min(where(F.col("entity"))).alias("entity_at"),
        F.max_by("end", where(F.col("shown"))).alias("end"), F.max(where(F.col("shown"))).alias("shown_at"),
    )
    given = F.when(F.col("shown_at").isNotNull(), F.col("_block"))
    found = blocks.groupBy("_file").agg(
        F.bool_and("known").alias("known"), F.sum("heads").alias("heads"), F.sum("tails").alias("tails"),
        F.min_by(F.col("head_at") == F.col("first"), "_block").alias("starts"), F.max_by(F.col("tail_at") == F.col("last"), "_block").alias("ends"),
        F.min_by("root", "_block").alias("root"), F.min_by("root_tag", "_block").alias("root_tag"), F.min("root_at").alias("root_at"),
        F.min("entity_at").alias("entity_at"), F.max_by("end", given).alias("end"),
    )
    plain = F.col("known") & (F.col("heads") == 1) & (F.col("tails") == 1) & F.col("starts") & F.col("ends")
    return found.select(
        F.col("_file").alias("file"), F.coalesce("root", F.lit("")).alias("root"), "root_tag", F.coalesce("end", F.lit(False)).alias("closed"),
        F.coalesce(F.col("entity_at") <= F.col("root_at"), F.col("entity_at").isNotNull()).alias("has_entities"),
        F.coalesce(plain, F.lit(False)).alias("plain"),
    )


def _by_reader(documents: DataFrame, path: str | list[str]) -> tuple[str | list[str] | None, str | list[str] | None]:
    """What is read in blocks and what file by file: the paths as they are if all files are alike, else their names."""
    odd, all_files = documents.where("not plain").count(), documents.count()
    if odd == 0:
        return (path, None) if all_files else (None, path)
    if odd == all_files:
        return None, path
    # As paths to read: decoded, with the signs of patterns escaped.
    name = F.regexp_replace(urls.percent_decode(F.col("file"), plus=False), r"([\\{}\[\]*?])", r"\\$1")
    names = lambda plain: [r[0] for r in documents.where(F.col("plain") == plain).select(name).toLocalIterator()]
    return names(True), names(False)


def number_by_block(rows: DataFrame) -> DataFrame:
    """1..n over (_file, _block, _at) without moving the rows.

    ``_at`` counts up by one inside a block, so a row's place is its distance from the block's first row plus the sizes of the
    earlier blocks of its file and of all earlier files. Block sizes are a table, so counting them before the join costs
    nothing: few are broadcast, many join by shuffle. Files that are cut into other blocks at the second reading fail it.
    """
    blocks = stored(rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")), "blocks")
    before = lambda column, window: F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = blocks.groupBy("_file").agg(F.sum("_n").alias("_n")).select("_file", before("_n", Window.orderBy("_file")).alias("_start"))
    within = F.col("_start") + before("_n", Window.partitionBy("_file").orderBy("_block"))
    offsets = blocks.join(files, "_file").select("_file", "_block", "_n", "_first", within.alias("_offset"))
    place = F.col("_at") - F.col("_first")
    moved = F.raise_error(F.lit("XML files were cut into other blocks between two readings")).cast("long")
    return (
        rows.join(ordering.broadcast_if_small(offsets), ["_file", "_block"], "left")
        .withColumn("index", F.when((place >= 0) & (place < F.col("_n")), F.col("_offset") + place + 1).otherwise(moved))
        .drop("_file", "_block", "_at", "_n", "_first", "_offset")
    )


def _is_base64(field: str) -> Column:
    return F.lower(F.coalesce(F.col(f"{field}._base64"), F.lit("false"))) == "true"


def from_xml_rows(rows: DataFrame) -> DataFrame:
    """Raw XML rows (with ``index``) to items: decoding, header parsing, host fallback, tool names."""
    field = lambda name: tx.strip(F.coalesce(F.col(name), F.lit("")))
    base = rows.select(
        "index",
        F.coalesce("_tool", F.lit("")).alias("raw_tool"),
        field("time").alias("time_raw"), field("url").alias("url"), field("host._VALUE").alias("xml_host"),
        F.coalesce("host._ip", F.lit("")).alias("host_ip"), field("port").alias("xml_port"), field("protocol").alias("xml_protocol"),
        field("method").alias("method"), field("path").alias("path"), field("extension").alias("extension"),
        field("status").alias("status"), field("responselength").alias("response_length"), field("mimetype").alias("mime_type"),
        field("comment").alias("comment"),
        http.decode_field(F.col("request._VALUE"), _is_base64("request")).alias("request_raw"),
        http.decode_field(F.col("response._VALUE"), _is_base64("response")).alias("response_raw"),
        F.when(_is_base64("response"), F.col("response._VALUE")).alias("response_base64"),
    )
    return normalise(fill_from_url(base))


def fill_from_url(rows: DataFrame) -> DataFrame:
    """Where the host is missing, take host and, if missing too, protocol and port from the URL."""
    lacking = (F.col("xml_host") == "") & (F.col("url") != "")

    def filled(column: str, from_url: Column) -> Column:
        return F.when(lacking & (F.col(column) == ""), from_url).otherwise(F.col(column))

    url = F.col("url")
    return rows.withColumns(
        {
            "host": filled("xml_host", urls.hostname(url)),
            "protocol": filled("xml_protocol", urls.scheme(url)),
            "port": filled("xml_port", urls.port(url)),
        }
    )


def normalise(rows: DataFrame) -> DataFrame:
    """Parse the raw messages and derive hash, slug, tool and time. Bytes are kept for WebAssembly only."""
    url, request, response = F.col("url"), F.col("request_raw"), F.col("response_raw")
    wasm = F.lower(urls.path(url)).endswith(".wasm") | F.lower("mime_type").contains("wasm")
    tool = http.normalise_tool(F.col("raw_tool"))
    return conform(
        rows.withColumns(
            {
                "time": http.lenient_time(F.col("time_raw")),
                "request_headers": http.headers_of(request),
                "request_body": http.body(request),
                "response_headers": http.headers_of(response),
                "response_body": http.body(response),
                "response_status_line": http.first_line(response),
                "response_bytes": F.when(wasm & F.col("response_base64").isNotNull(), http.base64_bytes(F.col("response_base64"))),
                "sha256": F.sha2(request.cast("binary"), 256),
                "slug": http.slug(F.col("index"), F.col("method"), F.col("path")),
                "tool": F.when(tool == "unknown", http.infer_tool(F.col("comment"))).otherwise(tool),
            }
        )
    )


def document_summary(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Per XML file: root element, start and end tags, entity declarations, export metadata.

    The head is looked for in the first block of a file, the end in the last ``TAIL`` characters after its last item.
    """
    attribute = lambda name: F.regexp_extract("root_tag", rf"\b{name}=[\"']([^\"']*)", 1)
    return _documents(spark, path).select(
        "file", "root", "closed", "has_entities", attribute(r"\w+Version").alias("tool_version"), attribute("exportTime").alias("export_time"),
    )


def check_xml(spark: SparkSession, path: str | list[str]) -> None:
    """Refuse a wrong root element, a truncated document or entity declarations."""
    _refuse_bad(_documents(spark, path))


def _refuse_bad(documents: DataFrame) -> None:
    bad = documents.where((F.col("root") != "items") | ~F.col("closed") | F.col("has_entities"))
    first = bad.select("file", "root", "closed", "has_entities").first()  # one row at most
    if first is not None:
        if first["root"] != "items":
            raise ValueError("Expected an <items> document")
        raise ValueError(f"Invalid or incomplete XML: {first['file']}")


def read_export(spark: SparkSession, path: str | list[str], import_format: str = "xml") -> DataFrame:
    if import_format != "xml":
        raise ValueError("Only the XML item format is supported")
    return read_xml(spark, path)


def export_meta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """First non-empty tool version and export time over the files, in file order, and the file count."""
    meta = document_summary(spark, path)
    given = lambda c: F.when(F.col(c) != "", F.col(c))
    at = lambda c: F.when(F.col(c) != "", F.col("file"))
    return meta.agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.min_by(given("tool_version"), at("tool_version")), F.lit("")).alias("tool_version"),
        F.coalesce(F.min_by(given("export_time"), at("export_time")), F.lit("")).alias("export_time"),
    )


# -- JSON --------------------------------------------------------------------
_METADATA = [
    "tool", "time", "url", "host", "host_ip", "port", "protocol", "method", "path", "extension", "status",
    "response_length", "mime_type", "comment", "sha256", "session_tag",
]
_HEADER_MAP = T.MapType(_TEXT, _TEXT)
ITEM_JSON = T.StructType(
    [
        T.StructField("metadata", T.StructType([T.StructField("index", T.LongType()), *[T.StructField(n, _TEXT) for n in _METADATA]])),
        T.StructField("request", T.StructType([T.StructField("raw", _TEXT), T.StructField("headers", _HEADER_MAP), T.StructField("body", _TEXT)])),
        T.StructField(
            "response",
            T.StructType(
                [T.StructField("status_line", _TEXT), T.StructField("raw", _TEXT), T.StructField("headers", _HEADER_MAP), T.StructField("body", _TEXT)]
            ),
        ),
    ]
)


def read_item_json(spark: SparkSession, path: str, per_item_files: bool = True, max_file_bytes: int | None = None) -> DataFrame:
    """Nested item JSON below a folder: one file per item (``0001_*.json``) or JSON lines.

    Rows that are not usable keep a ``reject_reason``; use ``filters`` helpers to split them. Files over
    ``max_file_bytes``, where that is set, are not opened; ``oversized_files`` lists them.
    """
    reader = spark.read.schema(ITEM_JSON).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    if per_item_files:
        meta = F.col("_metadata")
        named = meta["file_name"].rlike(r"^\d+_.+\.json$")
        fits = F.lit(True) if max_file_bytes is None else meta["file_size"] <= max_file_bytes
        rows = reader.option("multiLine", "true").json(path).where(named & fits)
    else:
        rows = reader.json(path)
    return from_item_json(rows)


def oversized_files(spark: SparkSession, path: str, max_file_bytes: int) -> DataFrame:
    """``(file, length, reason)`` of item files that ``read_item_json`` leaves out at this limit; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    return files.where(F.col("length") > max_file_bytes).select(
        F.col("path").alias("file"), "length", F.lit("Traffic byte limit").alias("reason")
    )


def from_item_json(rows: DataFrame) -> DataFrame:
    """Nested item structs to items, with a reason on rows lacking a section or failing the item gate."""
    entries = lambda c: F.transform(
        F.map_entries(c), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value"))
    )
    missing = F.col("metadata").isNull() | F.col("request").isNull() | F.col("response").isNull()
    flat = rows.select(
        F.col("metadata.index").alias("index"),
        *[F.col(f"metadata.{n}").alias("time_raw" if n == "time" else n) for n in _METADATA],
        F.col("request.raw").alias("request_raw"), entries(F.col("request.headers")).alias("request_headers"),
        F.col("request.body").alias("request_body"), F.col("response.status_line").alias("response_status_line"),
        F.col("response.raw").alias("response_raw"), entries(F.col("response.headers")).alias("response_headers"),
        F.col("response.body").alias("response_body"), missing.alias("_missing"),
    ).withColumn("time", http.lenient_time(F.col("time_raw")))
    items = conform(flat)
    gated = filters.validity(items.withColumn("_missing", F.col("index").isNull()))
    reason = F.when(F.col("_missing"), F.lit("Unsupported item schema or method")).otherwise(F.col("reject_reason"))
    return gated.withColumn("reject_reason", reason).drop("_missing")


def read_findings(spark: SparkSession, path: str, array_document: bool = False) -> DataFrame:
    """Findings written as JSON lines, or as one JSON array per file."""
    schema = "category string, severity string, title string, detail string, host string, items array<string>"
    return spark.read.schema(schema).option("multiLine", str(array_document).lower()).json(path)


def read_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(checks, sources) of a review catalog document."""
    schema = (
        "id string, version string, checks array<struct<id:string,title:string,sourceIds:array<string>>>, "
        "sources map<string,struct<title:string,publisher:string,url:string>>"
    )
    document = spark.read.schema(schema).option("multiLine", "true").json(path)
    checks = document.select(F.explode("checks").alias("c")).select(
        F.col("c.id").alias("check_id"), F.col("c.title").alias("title"), F.col("c.sourceIds").alias("source_ids")
    )
    sources = document.select(F.explode("sources").alias("source_id", "s")).select("source_id", "s.title", "s.publisher", "s.url")
    return checks, sources


def attribute_checks(checks: DataFrame, sources: DataFrame) -> DataFrame:
    """Checks with their sources; ``known`` is false where the catalog lacks the cited source."""
    cited = checks.select("check_id", F.explode("source_ids").alias("source_id"))
    joined = ordering.lookup_join(cited, sources.withColumn("known", F.lit(True)), ["source_id"], ["check_id"], "left")
    return joined.withColumn("known", F.coalesce("known", F.lit(False)))


def attributed_checks(checks: DataFrame, sources: DataFrame) -> DataFrame:
    """As ``attribute_checks``, failing on any unknown source id."""
    error = F.raise_error(F.concat(F.lit("Unknown catalog source: "), "source_id")).cast("boolean")
    return attribute_checks(checks, sources).withColumn("known", F.when(F.col("known"), F.lit(True)).otherwise(error))


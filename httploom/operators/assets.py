"""Client-side assets in responses: scripts, WebAssembly modules and routes named in scripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import http, urls
from ..functions import text as tx
from . import ordering

WASM_MAGIC = "0061736D"  # NUL, a, s, m


def _is_script() -> Column:
    mime = F.lower("mime_type")
    return (mime == "script") | urls.path(F.col("url")).endswith(".js") | mime.contains("javascript")


def _is_wasm() -> Column:
    return urls.path(F.col("url")).endswith(".wasm") | F.lower("mime_type").contains("wasm")


def client_assets(items: DataFrame) -> DataFrame:
    """Script and WebAssembly responses with a safe, not yet unique, file name."""
    kind = F.when(_is_script(), F.lit("js")).when(_is_wasm(), F.lit("wasm"))
    chosen = items.where((F.col("response_body") != "") & (_is_script() | _is_wasm())).withColumn("kind", kind)
    last = F.regexp_extract(urls.path(F.col("url")), r"([^/]*)/*$", 1)
    name = F.when(last == "", F.concat(F.lit("asset_"), F.col("index").cast("string"))).otherwise(last)
    suffix = F.concat(F.lit("."), "kind")
    return chosen.withColumn(
        "file_name", http.safe_segment(F.when(F.endswith(name, suffix), name).otherwise(F.concat(name, suffix)))
    )


def unique_names(rows: DataFrame, order_col: str = "index", bits: int = ordering.PIECE_BITS) -> DataFrame:
    """``name.ext``, ``name_1.ext``, ... in order; numbers that another file's own name uses are passed over.

    A name everybody uses is numbered piece by piece. Of the names that use a number of another name, only
    the ends of runs of used numbers are kept per name.
    """
    numbered = ordering.group_row_number(rows, ["file_name"], order_col, "_copy", start=0, bits=bits)
    stem = F.regexp_extract("file_name", r"^(.*?)(\.[^.]*)?$", 1)
    extension = F.regexp_extract("file_name", r"(\.[^.]*)$", 1)
    suffixed = r"^(.*)_([1-9][0-9]{0,17})((?:\.[^.]*)?)$"
    used = rows.select("file_name").distinct().where(F.col("file_name").rlike(suffixed)).select(
        F.concat(F.regexp_extract("file_name", suffixed, 1), F.regexp_extract("file_name", suffixed, 3)).alias("file_name"),
        F.regexp_extract("file_name", suffixed, 2).cast("long").alias("_number"),
    )
    repeated = numbered.where("_copy = 1").select("file_name")
    place = F.row_number().over(Window.partitionBy("file_name").orderBy("_number"))
    # With j used numbers up to u_j, the copy that comes after u_j - j others moves on by j.
    shifts = (
        used.join(repeated, "file_name", "left_semi")
        .withColumn("_moved", place)
        .groupBy("file_name", (F.col("_number") - F.col("_moved")).alias("_others"))
        .agg(F.max("_moved").alias("_moved"))
        .groupBy("file_name")
        .agg(F.collect_list(F.struct("_others", "_moved")).alias("_shifts"))
    )
    known = ordering.lookup_join(numbered, shifts, ["file_name"], [order_col], "left")
    passed = F.filter("_shifts", lambda s: s["_others"] < F.col("_copy"))
    moved = F.coalesce(F.array_max(F.transform(passed, lambda s: s["_moved"])), F.lit(0))
    number = (F.col("_copy") + moved).cast("string")
    unique = F.when(F.col("_copy") == 0, F.col("file_name")).otherwise(F.concat(stem, F.lit("_"), number, extension))
    return known.withColumn("unique_name", unique).drop("_copy", "_shifts")


def script_routes(scripts: DataFrame, prefix: str = "/api/") -> DataFrame:
    """Distinct quoted local paths below ``prefix`` per script."""
    pattern = "[\"'](" + "".join(f"\\{c}" if not c.isalnum() and c != "/" else c for c in prefix) + r"[a-zA-Z0-9_\-\./]+)[\"']"
    routes = F.array_distinct(F.regexp_extract_all("response_body", F.lit(pattern), 1))
    return scripts.select("index", "host", "url", F.explode(routes).alias("route"))


def wasm_modules(items: DataFrame) -> DataFrame:
    """Module bytes after the message head; bodies without the module magic are dropped."""
    data = F.col("response_bytes")
    # Latin-1 text has one character per byte, so text positions are byte positions.
    blank_line = F.locate("\r\n\r\n", F.decode(data, "ISO-8859-1"))
    body = F.when(blank_line > 0, data.substr(blank_line + 4, F.octet_length(data))).otherwise(data)
    modules = items.where(_is_wasm() & data.isNotNull()).withColumn("module", body)
    return modules.where(F.hex(F.substring("module", 1, 4)) == WASM_MAGIC)

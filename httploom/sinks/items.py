"""Item JSON, partition layouts, snapshot table, artifacts and replaceable index builds."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import http
from ..functions import text as tx

METADATA = [
    "index", "tool", "time_raw", "url", "host", "host_ip", "port", "protocol", "method", "path", "extension", "status",
    "response_length", "mime_type", "comment", "sha256", "session_tag",
]
SNAPSHOT_COLUMNS = [
    "item_index", "slug", "tool", "time", "url", "host", "port", "protocol", "method", "path", "extension", "status",
    "response_length", "mime_type", "comment", "sha256", "session_tag", "request_raw", "request_headers", "request_body",
    "response_status_line", "response_raw", "response_headers", "response_body",
]


def nested(items: DataFrame, *extra: str) -> DataFrame:
    """The exchange form: ``metadata`` / ``request`` / ``response`` structs, headers as a JSON object.

    ``extra`` columns are carried along (partition columns of a layout).
    """
    return items.select(
        *extra,
        F.struct(*[F.col(c).alias("time" if c == "time_raw" else c) for c in METADATA]).alias("metadata"),
        F.struct(
            F.col("request_raw").alias("raw"), F.map_from_entries("request_headers").alias("headers"), F.col("request_body").alias("body")
        ).alias("request"),
        F.struct(
            F.col("response_status_line").alias("status_line"), F.col("response_raw").alias("raw"),
            F.map_from_entries("response_headers").alias("headers"), F.col("response_body").alias("body"),
        ).alias("response"),
    )


# -- layouts -----------------------------------------------------------------
SESSION_BUCKETS = 64


def session_dir(tag: Column) -> Column:
    return http.safe_dirname(tx.or_else(tag, "session_anon"))


def session_bucket(session: Column) -> Column:
    """Folder of a session: sessions grow with the traffic, folders do not."""
    return F.lpad(F.pmod(F.xxhash64(session), F.lit(SESSION_BUCKETS)).cast("string"), 2, "0")


def layout_columns(layout: str, include_host: bool = False) -> dict[str, Column]:
    """Partition columns of a layout, outermost first."""
    tool = http.safe_dirname(F.col("tool"))
    host = http.safe_dirname(tx.or_else(F.col("host"), "unknown"))
    part = lambda fmt: F.coalesce(F.date_format("time", fmt), F.lit("unknown_datetime"))
    layouts = {
        "flat": {"tool_dir": tool},
        "by_host": {"tool_dir": tool, "host_dir": host},
        "host_first": {"host_dir": host, "tool_dir": tool},
        "site_map": {"host_dir": host},
        "by_session": {"session_bucket": session_bucket(session_dir(F.col("session_tag"))), "tool_dir": tool},
        "by_time": {"date": part("yyyy-MM-dd"), "hour": part("HH"), "minute": part("mm"), **({"host_dir": host} if include_host else {})},
    }
    if layout not in layouts:
        raise ValueError(f"Unknown layout: {layout}")
    return layouts[layout]


def inner_columns(layout: str) -> dict[str, Column]:
    """Sorted columns below the folders of a layout, where folders of their own would be too many."""
    inner = {
        "site_map": {"path_segments": http.path_segments(F.col("path"), F.col("url"))},
        "by_session": {"session_dir": session_dir(F.col("session_tag"))},
    }
    return inner.get(layout, {})


def arranged(items: DataFrame, layout: str, include_host: bool = False) -> tuple[DataFrame, list[str]]:
    """Items with their layout columns. ``rebalance`` sizes the output files: rows of one directory meet
    in few tasks, and a directory holding much of the data is split over many."""
    columns, inner = layout_columns(layout, include_host), inner_columns(layout)
    tagged = items.withColumns({**columns, **inner})
    return tagged.hint("rebalance", *columns).sortWithinPartitions(*columns, *inner, "index"), list(columns)


def write_items(items: DataFrame, path: str, layout: str = "flat", fmt: str = "json", include_host: bool = False) -> None:
    """Write items in a layout. An existing target is refused, an empty selection is an error.

    Emptiness is tested on one narrow column first, so a refused call leaves nothing behind.
    """
    if items.select("index").isEmpty():
        raise ValueError("No items match the selection")
    rows, partition = arranged(items, layout, include_host)
    if fmt == "json":
        rows = nested(rows, *partition, *inner_columns(layout))
    rows.write.mode("errorifexists").partitionBy(*partition).format(fmt).save(path)


def of_session(rows: DataFrame, session: str) -> DataFrame:
    """Rows of one session of a ``by_session`` layout that was read with its folders as columns; other folders are not read."""
    name = session_dir(F.lit(session))
    return rows.where((F.col("session_bucket") == session_bucket(name)) & (F.col("session_dir") == name))


# -- snapshot ----------------------------------------------------------------
def snapshot(items: DataFrame) -> DataFrame:
    """Flat 24-column form with headers as JSON text."""
    headers = lambda c: F.to_json(F.map_from_entries(c))
    given = {
        "item_index": F.col("index"), "time": F.col("time_raw"), "request_headers": headers("request_headers"),
        "response_headers": headers("response_headers"),
    }
    return items.select(*[given.get(c, F.col(c)).alias(c) for c in SNAPSHOT_COLUMNS])


def write_snapshot(items: DataFrame, path: str) -> None:
    """Replace the snapshot. Sorting inside files gives host, method and status min/max pruning."""
    _sorted_snapshot(items).write.mode("overwrite").parquet(path)


def _sorted_snapshot(items: DataFrame) -> DataFrame:
    """``rebalance`` bounds what one task sorts, whatever the input's splits hold and however few hosts there are."""
    return snapshot(items).hint("rebalance").sortWithinPartitions("host", "method", "status")


def save_snapshot_table(items: DataFrame, table: str) -> None:
    _sorted_snapshot(items).write.mode("overwrite").format("parquet").saveAsTable(table)


def write_artifact(result: DataFrame, path: str, fmt: str = "json") -> None:
    """Any operator result as files of its own; an existing target is refused."""
    result.write.mode("errorifexists").format(fmt).save(path)


# -- replaceable builds ------------------------------------------------------
def publish_build(result: DataFrame, root: str) -> str:
    """Write a complete build beside older ones, then append the pointer row that selects it.

    Readers see the old build until the append commits; a failed build leaves the pointer alone.
    """
    build = f"build-{uuid.uuid4().hex}"
    result.write.parquet(f"{root}/{build}")
    spark = result.sparkSession
    pointer = spark.createDataFrame([(build,)], "build string").withColumn("published", F.current_timestamp())
    pointer.write.mode("append").parquet(f"{root}/pointer")
    return build


def read_build(spark: SparkSession, root: str) -> DataFrame:
    """The build published last."""
    newest = spark.read.parquet(f"{root}/pointer").orderBy(F.desc("published"), F.desc("build")).first()
    if newest is None:
        raise ValueError("No published build; publish one first")
    return spark.read.parquet(f"{root}/{newest['build']}")

"""Source trees: which files are indexed, and their text, hash and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import http, names

# The extension rule as a file-name glob in either case.
SOURCE_GLOB = (
    "*.{[jJtT][sS],[jJtT][sS][xX],[cCmM][jJtT][sS],[cCmM][jJtT][sS][xX],[pP][yY],[jJ][aA][vV][aA]}"
)


def skip_reason(path: Column, length: Column, content: Column, excludes: list[str] | None = None, max_bytes: int | None = None) -> Column:
    """Why a file (relative path) is left out; null for files to index."""
    parts = F.split(path, "/")
    excluded = F.lit(False)
    for entry in excludes or []:
        prefix = entry.replace("\\", "/").rstrip("/")
        excluded = excluded | (path == prefix) | path.startswith(prefix + "/")
    name = F.element_at(parts, -1)
    return (
        F.when(F.exists(parts, lambda p: p.startswith(".") | F.lower(p).isin(*names.SKIPPED_FOLDERS)) | excluded, F.lit("excluded"))
        .when(~name.rlike(names.SOURCE_EXTENSION) | name.rlike(names.SKIPPED_FILE), F.lit("not source"))
        .when(F.lit(False) if max_bytes is None else length > max_bytes, F.lit("Source byte limit"))
        .when(F.locate("\x00", F.decode(content, "ISO-8859-1")) > 0, F.lit("Binary source omitted"))
    )


def gate_files(files: DataFrame, excludes: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Add ``reason`` to files with ``file``, ``length`` and ``content`` columns."""
    return files.withColumn("reason", skip_reason(F.col("file"), F.col("length"), F.col("content"), excludes, max_bytes))


def indexed_files(files: DataFrame, excludes: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Usable files with text and content hash."""
    kept = gate_files(files, excludes, max_bytes).where(F.col("reason").isNull())
    return kept.select(
        "file", "length", http.bytes_text(F.col("content")).alias("text"), F.sha2("content", 256).alias("hash")
    )


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(file, length, content)`` of the files whose extension is a source's; the listing is pruned by it."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", SOURCE_GLOB).load(folder)
    )
    root = folder.rstrip("/")
    relative = F.regexp_replace(F.col("path"), "^(?:file:/*)?/?" + "\\Q" + root.lstrip("/") + "\\E/", "")
    return listing.select(relative.alias("file"), "length", "content")


def read_source(spark: SparkSession, folder: str, excludes: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Index a source folder; ``omitted_source`` gives what is left out and why."""
    return indexed_files(source_files(spark, folder), excludes, max_bytes)


def omitted_source(spark: SparkSession, folder: str, excludes: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """``(file, length, reason)`` of the files that ``read_source`` does not index."""
    gated = gate_files(source_files(spark, folder), excludes, max_bytes)
    return gated.where(F.col("reason").isNotNull()).select("file", "length", "reason")

"""Shared pieces of the operators: table reading, Arrow slices bounded by bytes, size checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from httploom.session import scratch

SLICE_BYTES = 4 << 20
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``(id, text)`` under fixed names, null text as empty; other columns cannot clash."""
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice take ``limit`` bytes, or are one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(byte_lengths(batch.column(text)))
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def byte_lengths(texts: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def fits_broadcast(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> bool:
    """Whether the summed ``size`` of all rows stays within ``limit``."""
    return (df.agg(F.sum(size)).first()[0] or 0) <= limit


def packaged(fn: Callable, **fixed) -> Callable:
    """``fn(batches, **fixed)`` as the one-argument function that mapInArrow takes."""

    def run(batches):
        return fn(batches, **fixed)

    return run


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written below the shared root and read again: evaluated once, and safe from lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered_columns(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named by their numbers, which nothing inside an operator is, and the numbers of ``names``."""
    at = {name: f"c{number}" for number, name in enumerate(df.columns)}
    return df.toDF(*at.values()), [at[name] for name in names]


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that ``df`` has not got, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out

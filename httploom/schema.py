"""The ``items`` schema: one row per captured request/response pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text as tx

HEADER = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
HEADERS = T.ArrayType(HEADER)
PAIR = HEADER

ITEMS = T.StructType(
    [
        T.StructField("index", T.LongType()),
        T.StructField("tool", T.StringType()),
        T.StructField("time", T.TimestampType()),
        T.StructField("time_raw", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("host_ip", T.StringType()),
        T.StructField("port", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("extension", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("response_length", T.StringType()),
        T.StructField("mime_type", T.StringType()),
        T.StructField("comment", T.StringType()),
        T.StructField("request_raw", T.StringType()),
        T.StructField("request_headers", HEADERS),
        T.StructField("request_body", T.StringType()),
        T.StructField("response_status_line", T.StringType()),
        T.StructField("response_raw", T.StringType()),
        T.StructField("response_headers", HEADERS),
        T.StructField("response_body", T.StringType()),
        T.StructField("response_bytes", T.BinaryType()),
        T.StructField("slug", T.StringType()),
        T.StructField("sha256", T.StringType()),
        T.StructField("session_tag", T.StringType()),
    ]
)

FINDING = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("host", T.StringType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("rule_order", T.IntegerType()),
        T.StructField("ord", T.LongType()),
    ]
)


def _missing(field: T.StructField) -> Column:
    if isinstance(field.dataType, T.StringType):
        return F.lit("")
    if isinstance(field.dataType, T.ArrayType):
        return F.array().cast(field.dataType)
    return F.lit(None).cast(field.dataType)


def conform(df: DataFrame) -> DataFrame:
    """Project any frame onto ``ITEMS``: missing text is ``''``, missing headers an empty array.

    Tools are stored in lower case and statuses without surrounding blanks, so that filters on them are
    plain comparisons that reach the Parquet scan.
    """
    columns = []
    for field in ITEMS.fields:
        if field.name not in df.columns:
            value = _missing(field)
        elif isinstance(field.dataType, (T.TimestampType, T.BinaryType, T.LongType)):
            value = F.col(field.name).cast(field.dataType)
        else:
            value = F.coalesce(F.col(field.name).cast(field.dataType), _missing(field))
            if field.name == "tool":
                value = F.lower(value)
            elif field.name == "status":
                value = tx.strip(value)
        columns.append(value.alias(field.name))
    return df.select(*columns)

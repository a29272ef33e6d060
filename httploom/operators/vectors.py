"""Documents for retrieval, and exact nearest neighbours over supplied embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dedup


def documents(items: DataFrame, body_limit: int | None = None) -> DataFrame:
    """Masked JSON document and metadata per item; embeddings are joined by the caller on ``id``.

    Bodies are whole; with ``body_limit`` they are cut to so many characters and ``truncated`` tells where one was.
    """
    masked = dedup.redact_items(items)
    bodies = ["request_body", "response_body"]
    shown = [F.col(c) if body_limit is None else F.substring(c, 1, body_limit) for c in bodies]
    long = F.lit(False) if body_limit is None else F.greatest(*(F.length(c) for c in bodies)) > body_limit
    text = F.to_json(F.struct(F.col("slug").alias("item"), "method", "url", shown[0].alias("request"), shown[1].alias("response")))
    return masked.select(
        F.col("index").cast("string").alias("id"), text.alias("document"), long.alias("truncated"), "method", "path", "host", "status"
    )


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared Euclidean distance, or cosine distance."""
    zero = F.lit(0.0)

    def total(values: Column) -> Column:
        return F.aggregate(values, zero, lambda acc, v: acc + v)

    as_double = lambda x, y: (x.cast("double"), y.cast("double"))
    if metric == "l2":
        def squared(x: Column, y: Column) -> Column:
            dx, dy = as_double(x, y)
            return (dx - dy) * (dx - dy)

        return total(F.zip_with(a, b, squared))
    if metric == "cosine":
        dot = total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))
        norm = lambda v: F.sqrt(total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))
        return F.lit(1.0) - dot / (norm(a) * norm(b))
    raise ValueError("metric must be l2 or cosine")


def nearest(index: DataFrame, query_vector: Column, n_results: int = 5, metric: str = "l2") -> DataFrame:
    """Exact top-k: one scan, k rows per task, no shuffle of the vectors.

    ``index``: id, embedding; ``query_vector``: a literal array or a scalar subquery. ``n_results`` is
    clamped to at least one and, by the limit itself, to the number of rows.
    """
    scored = index.withColumn("_query", query_vector).withColumn(
        "distance", distance(F.col("embedding"), F.col("_query"), metric)
    )
    return scored.drop("embedding", "_query").orderBy("distance", "id").limit(max(1, int(n_results)))

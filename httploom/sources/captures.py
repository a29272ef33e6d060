"""Combining captures: merge of several exports, union of proxy history and site map, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dedup, filters, ordering

_FILE_SHIFT = 48  # an order key holds the file number above 48 bits of item index


def merge(exports: list[DataFrame]) -> DataFrame:
    """Append exports in the given order and number the items through; slugs follow."""
    tagged = [
        df.withColumn("_order_key", F.col("index") + F.lit(n << _FILE_SHIFT)).drop("index") for n, df in enumerate(exports)
    ]
    combined = reduce(lambda a, b: a.unionByName(b), tagged)
    numbered = ordering.sequential_index(combined, "_order_key", "index").drop("_order_key")
    return dedup.rebuild_slug(numbered).select(*exports[0].columns)


def collect(
    proxy: DataFrame, site_map: DataFrame, hosts: list[str] | None = None, scope: DataFrame | None = None
) -> DataFrame:
    """Everything, or only some hosts and/or what is in scope, from both capture sources."""

    def chosen(items: DataFrame) -> DataFrame:
        if hosts is not None:
            items = filters.by_hosts(items, hosts)
        return items if scope is None else filters.in_scope(items, scope)

    return dedup.union_captures(chosen(proxy), chosen(site_map))


def coverage(items: DataFrame, declared: DataFrame) -> DataFrame:
    """Indexed item count against the ``total_items`` an export declares (one row each)."""
    indexed = items.agg(F.count(F.lit(1)).alias("indexed"))
    return indexed.select(
        "indexed", declared.select("total_items").scalar().alias("declared")
    ).withColumn("complete", F.col("indexed") == F.col("declared"))

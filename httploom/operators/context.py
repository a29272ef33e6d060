"""Bounded, masked context tables for an external reader. Nothing is sent anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import http, redact
from ..session import stored
from ..sinks import items as sink
from . import dedup, findings, review, surface

# Files of an export that come before its items.
SUMMARY_FILE, FINDINGS_FILE = "attack-surface-index.json", "security-findings.json"
FIRST_ITEMS = 1024  # items of an export that are measured before the rest; a switch of speed, not of results


def records(items: DataFrame, body_limit: int | None = None) -> DataFrame:
    """One masked JSON record per item: slug, method, url, status, bodies (cut at ``body_limit`` where that is set)."""
    masked = dedup.redact_items(items)
    shown = lambda name: F.col(name) if body_limit is None else F.substring(name, 1, body_limit)
    record = F.to_json(
        F.struct(
            F.col("slug").alias("item"), "method", "url", "status",
            shown("request_body").alias("request"),
            shown("response_body").alias("response"),
        )
    )
    return masked.select("index", "slug", record.alias("record"))


def _sizes(items: DataFrame, body_limit: int | None) -> DataFrame:
    return records(items, body_limit).select("index", "slug", F.length("record").cast("long").alias("size"))


def item_context(items: DataFrame, considered: int | None = None, budget: int = 60_000, body_limit: int | None = None) -> DataFrame:
    """Records of the first items in order while they fit.

    A record has two characters or more, so only the first ``budget / 2`` items can matter; they alone are masked to be measured,
    and those that fit are masked once more to be shown.
    """
    reach = budget // 2 + 1
    first = review.first_rows(items, "index", reach if considered is None else min(reach, considered))
    kept = review.prefix_budget(_sizes(first, body_limit).select("index", "size"), "index", F.col("size"), budget)
    shown = records(first.join(F.broadcast(kept.select("index")), "index", "left_semi"), body_limit)
    return shown.join(kept, "index")


def corpus_context(
    items: DataFrame, considered: int | None = None, budget: int = 48_000, max_items: int = 50, floor: int = 500, body_limit: int | None = None
) -> DataFrame:
    """Greedy selection in path order: what does not fit is skipped, at most ``max_items`` are kept.

    All items are masked once to be measured; the kept ones, at most ``max_items``, once more to be shown.
    """
    sized = _sizes(items, body_limit).select(F.lit(1).alias("corpus"), "slug", "index", (F.col("size") + 1).alias("size"))
    kept = review.budget_keys(sized, "corpus", ["slug", "index"], budget, considered, max_items, floor).drop("corpus", "slug")
    shown = records(items.join(F.broadcast(kept.select("index")), "index", "left_semi"), body_limit)
    return shown.join(kept, "index")


def _first_findings(found: DataFrame, limit: int) -> DataFrame:
    """One row: the masked JSON record of the ``limit`` first findings in report order."""
    order = F.struct(findings.severity_rank(F.col("severity")).alias("s"), "rule_order", "ord", "host", "title", "detail")
    first = found.withColumn("_order", order).orderBy("_order").limit(limit)
    masked = first.withColumns({name: redact.message_body(F.col(name)) for name in ("title", "detail")})
    listed = masked.agg(F.array_sort(F.collect_list(F.struct("_order", F.struct("category", "severity", "title", "detail", "host", "items").alias("f")))).alias("l"))
    return listed.select(F.to_json(F.struct(F.lit(FINDINGS_FILE).alias("file"), F.transform("l", lambda e: e["f"]).alias("data"))).alias("record"))


def export_records(items: DataFrame, body_limit: int | None = None) -> DataFrame:
    """One masked JSON record per item: metadata, headers and bodies of both messages (cut at ``body_limit`` where that is set)."""
    shown = lambda c: F.col(c) if body_limit is None else F.substring(c, 1, body_limit)
    part = lambda side: F.struct(F.col(f"{side}.headers").alias("headers"), shown(f"{side}.body").alias("body")).alias(side)
    data = F.struct("metadata", part("request"), part("response")).alias("data")
    masked = sink.nested(dedup.redact_items(items), "index", "slug")
    return masked.select("index", "slug", F.to_json(F.struct(F.col("slug").alias("file"), data)).alias("record"))


def _least_size() -> Column:
    """No more characters than an item's record in an export has: what masking may change is empty, all else is as it will be."""
    blank = lambda name: F.when(F.col(name).isNotNull(), F.lit(""))
    named = lambda name: F.map_from_entries(F.transform(name, lambda h: F.struct(h["name"], F.lit(""))))
    kept = {"time_raw": F.col("time_raw").alias("time"), "url": blank("url"), "path": blank("path"), "comment": blank("comment")}
    kept["sha256"] = F.sha2(blank("request_raw").cast("binary"), 256)
    metadata = F.struct(*[kept.get(c, F.col(c)).alias("time" if c == "time_raw" else c) for c in sink.METADATA])
    sides = [F.struct(named(f"{side}_headers").alias("headers"), blank(f"{side}_body").alias("body")).alias(side) for side in ("request", "response")]
    file = F.concat(http.slug_number(F.col("index")), F.lit("_"))
    return F.length(F.to_json(F.struct(file.alias("file"), F.struct(metadata.alias("metadata"), *sides).alias("data"))))


def _export_keys(items: DataFrame, budget: int, max_items: int, floor: int, used: int, body_limit: int | None) -> DataFrame:
    """``(index, size, position)`` of the items that the greedy selection of an export keeps.

    ``FIRST_ITEMS`` in path order are masked and measured first. If the selection goes on after them, all later items follow;
    those whose least size is over what is left cannot fit and need no masking to be skipped.
    """
    spark = items.sparkSession
    numbered = items.withColumn("_at", F.concat(http.slug_number(F.col("index")), F.lit("_")))  # slugs begin so, masked or not

    def keys(part: DataFrame, used: int, n: int) -> list:
        sized = export_records(part, body_limit).select(F.lit(1).alias("corpus"), "slug", "index", (F.length("record") + 1).alias("size"))
        spent = spark.createDataFrame([(1, used)], "corpus int, used long")
        return review.budget_keys(sized, "corpus", ["slug", "index"], budget, None, max_items - n, floor, spent).orderBy("position").select("index", "size").collect()

    first = numbered.select("_at", "index").orderBy("_at").limit(FIRST_ITEMS)
    bounds = stored(first, "first-items")
    kept = keys(items.join(F.broadcast(bounds.select("index")), "index", "left_semi"), used, 0)
    used += sum(r["size"] for r in kept)
    last = bounds.agg(F.count(F.lit(1)), F.max("_at")).first()
    if last[0] == FIRST_ITEMS and len(kept) < max_items and budget - used >= floor:
        later = numbered.where(F.col("_at") > last[1])
        fitting = later.where(_least_size() + 1 <= budget - used).drop("_at")
        kept += keys(fitting, used, len(kept))
    rows = [(r["index"], r["size"], n) for n, r in enumerate(kept, 1)]  # max_items at most
    return spark.createDataFrame(rows, "index long, size long, position int")


def export_context(
    items: DataFrame, found: DataFrame | None = None, budget: int = 48_000, max_items: int = 50, floor: int = 500, max_findings: int = 50,
    body_limit: int | None = None,
) -> DataFrame:
    """``(position, file, size, record)`` of a whole export: index summary, first findings, then items in path order.

    What does not fit is skipped. Items end at ``max_items`` or once less than ``floor`` is left. Items are masked to be measured
    for as long as they may fit, the kept ones once more to be shown.
    """
    totals = F.struct(F.struct(*surface.summary(items).columns).alias("summary")).alias("data")
    heads = [(SUMMARY_FILE, surface.summary(items).select(F.to_json(F.struct(F.lit(SUMMARY_FILE).alias("file"), totals)).alias("record")))]
    if found is not None:
        heads.append((FINDINGS_FILE, _first_findings(found, max_findings)))
    used, kept = 0, []
    for name, head in heads:  # two rows at most, each of bounded size
        record = head.first()["record"]
        if used + len(record) + 1 <= budget:
            used += len(record) + 1
            kept.append((len(kept) + 1, name, len(record) + 1, record))
    spark = items.sparkSession
    keys = _export_keys(items, budget, max_items, floor, used, body_limit)
    keys = keys.select("index", "size", (F.col("position") + len(kept)).alias("position"))
    shown = export_records(items.join(F.broadcast(keys.select("index")), "index", "left_semi"), body_limit).join(keys, "index")
    head = spark.createDataFrame(kept, "position int, file string, size long, record string")
    return head.unionByName(shown.select("position", F.col("slug").alias("file"), "size", "record"))

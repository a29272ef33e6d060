"""All review evidence of each endpoint: traffic, route and mount excerpts, chosen places, related declarations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from . import mapping, ordering, review

# Why an excerpt is shown.
ROUTE_REASON = "Literal method/path and statically resolved router mounts. Candidate linkage, not runtime reachability."
MOUNT_REASON = "Router registration and nearby middleware; global policy may be elsewhere."
CHOSEN_REASON = "Explicitly selected by the analyst to supply missing policy or service context. Relevance still requires review."
DECLARATION_REASON = ("Same-name declaration for ", "; caller binding and execution are NOT proven.")

TRAFFIC, SOURCE, DECLARATION = 0, 1, 2  # order of the kinds of evidence
PLACE = ["endpoint_id", "at", "file", "line", "kind", "reason"]


def _at(phase: int, *parts: Column) -> Column:
    """Place of evidence in its endpoint's order."""
    numbers = [*parts, *[F.lit(0)] * (3 - len(parts))]
    return F.array(F.lit(phase), *[n.cast("int") for n in numbers])


def traffic(items: DataFrame, endpoint_rows: DataFrame, samples: int, body_limit: int | None = None) -> DataFrame:
    """``(endpoint_id, at, evidence_id, kind, file, line, record)`` of an endpoint's masked samples."""
    found = mapping.sample_records(items, samples, body_limit)
    named = found.join(endpoint_rows.select("endpoint_id", *mapping.ENDPOINT_KEYS), mapping.ENDPOINT_KEYS)
    shown = [
        F.col("evidence_id").alias("id"), F.lit("traffic").alias("kind"), "file", "hash", "url", "status", "session_group",
        "request_headers", "request_body", "response_headers", "response_body",
    ]
    return named.select(
        "endpoint_id", _at(TRAFFIC, F.col("rank")).alias("at"), "evidence_id", F.lit("traffic").alias("kind"), "file",
        F.lit(None).cast("int").alias("line"), F.to_json(F.struct(*shown)).alias("record"),
    )


def matched_places(candidates: DataFrame, routes: DataFrame) -> DataFrame:
    """Places of the ranked matches, each followed by the mounts on the way to its router, from the root down.

    ``routes`` may have ``mounts``, an array of (file, line).
    """
    route = candidates.select(
        "endpoint_id", _at(SOURCE, F.col("rank")).alias("at"), "file", F.col("line").cast("int").alias("line"), F.lit("route").alias("kind"), F.lit(ROUTE_REASON).alias("reason")
    )
    if "mounts" not in routes.columns:
        return route
    trails = routes.where(F.size("mounts") > 0).select("route_id", "mounts")
    ranked = candidates.select("endpoint_id", "rank", "route_id")
    mounts = ordering.lookup_join(ranked, trails, ["route_id"], ["endpoint_id"]).select("endpoint_id", "rank", F.posexplode("mounts").alias("n", "m"))
    return route.unionByName(
        mounts.select(
            "endpoint_id", _at(SOURCE, F.col("rank"), F.col("n") + 1).alias("at"), F.col("m.file").alias("file"), F.col("m.line").alias("line"),
            F.lit("mount").alias("kind"), F.lit(MOUNT_REASON).alias("reason"),
        )
    )


def chosen_places(chosen: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` (endpoint_id, file, line) that an analyst chose for each endpoint, in file and line order, after the matches."""
    first = ordering.smallest_per_group(chosen.where("line > 0").select("endpoint_id", "file", "line").distinct(), ["endpoint_id"], [F.col("file"), F.col("line")], limit)
    return first.select(
        "endpoint_id", _at(SOURCE, F.lit(2**30), F.col("rank")).alias("at"), "file", F.col("line").cast("int").alias("line"),
        F.lit("analyst-selected").alias("kind"), F.lit(CHOSEN_REASON).alias("reason"),
    )


def source_records(places: DataFrame, files: DataFrame, before: int, after: int, limit: int | None) -> DataFrame:
    """``(endpoint_id, at, evidence_id, kind, file, line, record, text)`` of places inside existing files.

    Places of an endpoint whose excerpts start alike are one, the first. A place is cut and masked once, however many
    endpoints show it.
    """
    start = F.greatest(F.lit(1), F.col("line") - before)
    first = Window.partitionBy("endpoint_id", "file", "start").orderBy("at")
    own = places.withColumn("start", start).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*PLACE)
    wanted = own.select("file", "line").distinct()
    cut = review.cuts(files, wanted, before, after, limit)
    joined = ordering.lookup_join(own, cut, ["file", "line"], ["endpoint_id"])
    shown = [F.col("evidence_id").alias("id"), "kind", "file", "start", "end", "line", F.col("hash").alias("source_hash"), "reason", "truncated", "text"]
    return joined.select("endpoint_id", "at", "evidence_id", "kind", "file", "line", F.to_json(F.struct(*shown)).alias("record"), "start", "text")


def review_evidence(
    items: DataFrame,
    endpoint_rows: DataFrame,
    routes: DataFrame,
    files: DataFrame,
    chosen: DataFrame | None = None,
    budget: int = 55_000,
    samples: int = 3,
    matches: int = 6,
    picks: int = 5,
    related: int = 8,
    before: int = 10,
    after: int = 45,
    body_limit: int | None = None,
    text_limit: int | None = None,
) -> DataFrame:
    """``(endpoint_id, position, evidence_id, kind, file, line, size, record)``: what fits each endpoint's budget, in order.

    ``endpoint_rows`` carry the ``effective_path`` that their rewrites gave them; ``routes`` are the composed ones, with their
    ``mounts``; ``files``: file (unique), text; ``chosen``: endpoint_id, file, line. Order: the first ``samples`` traffic variants,
    the ``matches`` best routes, each with its mounts, ``picks`` chosen places, then the first ``related`` same-name
    declarations of what the accepted route and mount excerpts call. A record that does not fit the ``budget`` of characters is
    left out and smaller ones after it may still go in. Everything per endpoint is bounded by these parameters and the length
    of mount trails; bodies and excerpts are whole unless ``body_limit`` or ``text_limit`` is set.
    """
    found = mapping.match_routes(endpoint_rows, routes)
    candidates = stored(mapping.ranked_candidates(found, matches), "candidates")
    places = matched_places(candidates, routes)
    if chosen is not None:
        places = places.unionByName(chosen_places(chosen, picks))
    source = stored(source_records(places, files, before, after, text_limit), "evidence")
    columns = ["endpoint_id", "at", "evidence_id", "kind", "file", "line", "record"]
    first = stored(traffic(items, endpoint_rows, samples, body_limit).select(*columns).unionByName(source.select(*columns)), "evidence")
    size = F.length("record").cast("long").alias("size")
    kept = stored(review.budget_keys(first.select("endpoint_id", "at", size), "endpoint_id", ["at"], budget), "kept")

    shown = source.where(F.col("kind").isin("route", "mount")).join(kept, ["endpoint_id", "at"], "left_semi").select("endpoint_id", "text")
    declared = review.related_declarations(shown, files, related).select(
        "endpoint_id", _at(DECLARATION, F.col("rank")).alias("at"), "file", F.col("line").cast("int").alias("line"), F.lit("related-symbol").alias("kind"),
        F.concat(F.lit(DECLARATION_REASON[0]), "name", F.lit(DECLARATION_REASON[1])).alias("reason"),
    )
    starts = source.select("endpoint_id", "file", "start").distinct()
    new = source_records(declared, files, before, after, text_limit).join(starts, ["endpoint_id", "file", "start"], "left_anti")
    last = stored(new.select(*columns), "evidence")
    used = kept.groupBy("endpoint_id").agg(F.sum("size").alias("used"))
    more = review.budget_keys(last.select("endpoint_id", "at", size), "endpoint_id", ["at"], budget, used=used)
    keys = kept.drop("position").unionByName(more.drop("position"))
    number = F.row_number().over(Window.partitionBy("endpoint_id").orderBy("at"))
    chosen_rows = first.unionByName(last).join(keys, ["endpoint_id", "at"]).withColumn("position", number)
    return chosen_rows.select("endpoint_id", "position", "evidence_id", "kind", "file", "line", "size", "record")

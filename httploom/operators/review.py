"""Evidence for manual review: test plans, citations, source excerpts and cross-references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, redact
from ..functions import text as tx
from ..session import stored
from . import ordering

# Review checks and the profiles that group them.
CHECK_TITLES = {
    "AUTHZ-01": "Object ownership and tenant isolation",
    "AUTHZ-02": "Function, role and property authorization",
    "INPUT-01": "Input to query, template or process boundary",
    "INPUT-02": "Outbound requests and redirect boundaries",
    "INPUT-03": "File paths, uploads and deserialization",
    "SESSION-01": "Authentication and session/token lifecycle",
    "SESSION-02": "Browser trust, CSRF, CORS and cookie behavior",
    "LOGIC-01": "State transitions and server-controlled values",
    "LOGIC-02": "Replay, idempotency and concurrency",
    "DATA-01": "Sensitive output, errors and exposure",
}
PROFILES = {
    "comprehensive": list(CHECK_TITLES),
    "authorization": ["AUTHZ-01", "AUTHZ-02", "DATA-01"],
    "injection": ["INPUT-01", "INPUT-02", "INPUT-03"],
    "session": ["SESSION-01", "SESSION-02"],
    "logic": ["LOGIC-01", "LOGIC-02"],
}


def test_plan(endpoint_rows: DataFrame, profile: str) -> DataFrame:
    """Every endpoint with every check of a profile, not yet run. The checks are a short literal array."""
    if profile not in PROFILES:
        raise ValueError("Unknown built-in review playbook.")
    checks = F.array(
        *[F.struct(F.lit(c).alias("check_id"), F.lit(CHECK_TITLES[c]).alias("title")) for c in PROFILES[profile]]
    )
    return endpoint_rows.withColumn("check", F.explode(checks)).select(
        "endpoint_id", "method", "path", F.lit(profile).alias("profile"), "check.check_id", "check.title",
        F.lit("not-run").alias("status"), F.lit("").alias("observed_result"),
    )


# -- citations ---------------------------------------------------------------
def citation_check(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per finding: do all cited ids exist, and is at least one a traffic record?

    ``findings``: finding_id, evidence_ids; ``evidence``: evidence_id (unique), kind.
    """
    cited = findings.select("finding_id", F.explode_outer("evidence_ids").alias("evidence_id"))
    known = evidence.select("evidence_id", "kind")
    return (
        ordering.lookup_join(cited, known, ["evidence_id"], ["finding_id"], "left")
        .groupBy("finding_id")
        .agg(
            F.bool_and(F.col("kind").isNotNull()).alias("all_known"),
            F.coalesce(F.bool_or(F.col("kind") == "traffic"), F.lit(False)).alias("cites_traffic"),
        )
    )


def accept_findings(findings: DataFrame, evidence: DataFrame) -> DataFrame:
    """The findings, marked for validation; one invented or missing citation rejects the whole batch."""
    bad = citation_check(findings, evidence).where(~F.col("all_known") | ~F.col("cites_traffic"))
    violations = bad.agg(F.count(F.lit(1)).alias("n")).scalar()
    gate = F.when(
        violations > 0, F.raise_error(F.lit("Cited evidence is missing or no traffic record is cited. No findings accepted.")).cast("string")
    ).otherwise(F.lit("needs-validation"))
    return findings.withColumn("status", gate)


def stale_evidence(evidence: DataFrame, current: DataFrame) -> DataFrame:
    """Evidence whose stored hash no longer equals the current one, or whose file is gone."""
    keys = ["kind", "file"]
    stored = evidence.groupBy(*keys).agg(F.min("hash").alias("stored_hash"))
    now = current.select(*keys, F.col("hash").alias("current_hash"))
    return stored.join(now, keys, "left").where(
        F.col("current_hash").isNull() | (F.col("stored_hash") != F.col("current_hash"))
    )


# -- source excerpts ---------------------------------------------------------
HITS = 1024  # excerpts that are cut from one copy of a file's lines


def cuts(files: DataFrame, places: DataFrame, before: int, after: int, limit: int | None) -> DataFrame:
    """Numbered, masked lines around each (file, line) of ``places`` (distinct): evidence_id, file, start, end, line, hash, truncated, text.

    A file is split and hashed once for every ``HITS`` lines of it, however many places are in there. Masking comes before
    cutting, so a long secret cannot slip past the pattern at the cut. Lines beyond the end of a file give no row.
    """
    grouped = places.groupBy("file", F.floor(F.col("line") / HITS).alias("_part")).agg(F.collect_list("line").alias("_hits"))
    once = grouped.join(files.select("file", "text"), "file").select(
        "file", "_hits", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), F.split("text", r"\r?\n").alias("_lines")
    )

    def cut(line: Column) -> Column:
        start = F.greatest(F.lit(1), line - before)
        part = F.slice(F.col("_lines"), start, line + after - start + 1)
        return F.struct(start.alias("start"), F.least(F.size("_lines"), line + after).alias("end"), line.alias("line"), F.array_join(part, "\n").alias("text"))

    inside = F.filter(F.transform("_hits", lambda n: n.cast("int")), lambda n: n <= F.size("_lines"))
    masked = once.select("file", "hash", F.explode(F.transform(inside, cut)).alias("c")).select("file", "hash", "c.*").withColumn("_text", redact.source(F.col("text")))
    numbered = F.array_join(
        F.transform(F.split("_text", "\n"), lambda s, i: F.concat((F.col("start") + i).cast("string"), F.lit(": "), s)), "\n"
    )
    shown = F.col("_numbered") if limit is None else F.substring("_numbered", 1, limit)
    long = F.lit(False) if limit is None else F.length("_numbered") > limit
    evidence_id = tx.content_id("S", F.concat("file", F.lit(":"), F.col("start").cast("string")))
    return masked.select(evidence_id.alias("evidence_id"), "file", "start", "end", "line", "hash", numbered.alias("_numbered")).select(
        "evidence_id", "file", "start", "end", "line", "hash", long.alias("truncated"), shown.alias("text")
    )


def excerpts(files: DataFrame, hits: DataFrame, before: int = 10, after: int = 45, limit: int | None = None) -> DataFrame:
    """Excerpts of ``cuts`` around each hit, one per (file, start); cut at ``limit`` characters where a caller sets it.

    ``files``: file (unique), text; ``hits``: file, line, kind. Where hits start alike, the first line decides.
    """
    wanted = (
        hits.withColumn("start", F.greatest(F.lit(1), F.col("line") - before).cast("int"))
        .groupBy("file", "start")
        .agg(F.min("line").cast("int").alias("line"), F.min_by("kind", "line").alias("kind"))
    )
    found = cuts(files, wanted.select("file", "line"), before, after, limit)
    return found.join(wanted.select("file", "line", "kind"), ["file", "line"]).select(
        "evidence_id", "kind", "file", "start", "line", "hash", "truncated", "text"
    )


def declarations(files: DataFrame) -> DataFrame:
    """Function-like declarations by line: file, line, name. ``files``: file, text."""
    rows = files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "source"))
    name = F.lit("")
    for pattern in reversed(names.DECLARATION_PATTERNS):
        found = F.regexp_extract("source", pattern, 1)
        name = F.when(found != "", found).otherwise(name)
    return rows.select("file", (F.col("pos") + 1).alias("line"), name.alias("name")).where(F.col("name") != "")


def called_names(evidence: DataFrame) -> DataFrame:
    """Distinct called names per endpoint. ``evidence``: endpoint_id, text."""
    called = F.array_distinct(F.regexp_extract_all("text", F.lit(names.CALL_PATTERN), 1))
    return (
        evidence.select("endpoint_id", F.explode(called).alias("name"))
        .where(~F.col("name").isin(*names.CALL_STOPWORDS))
        .distinct()
    )


def related_declarations(evidence: DataFrame, files: DataFrame, limit: int = 8) -> DataFrame:
    """Same-name declarations for calls in the evidence: the first ``limit`` per endpoint by file and line.

    A declaration beyond the first ``limit`` of its own name cannot be among an endpoint's first ``limit``,
    so common names are cut to that before the join and cannot multiply it.
    """
    order = [F.col("file"), F.col("line")]
    first = ordering.smallest_per_group(declarations(files), ["name"], order, limit).drop("rank")
    joined = ordering.lookup_join(called_names(evidence), first, ["name"], ["endpoint_id"])
    return ordering.smallest_per_group(joined, ["endpoint_id"], order, limit)


# -- imports -----------------------------------------------------------------
def normalise_path(path: Column) -> Column:
    """Collapse ``.`` and ``..`` in a relative POSIX path."""
    empty = F.array().cast("array<string>")

    def step(kept: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(kept) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), kept), -1) != "..")
        return (
            F.when(up, F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(part.isin("", "."), kept)
            .otherwise(F.concat(kept, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), empty, step), "/")


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Defining file of each import: the first existing candidate path.

    ``imports``: file, spec, is_python; ``files``: file. Candidates meet the files on the full path.
    """
    folder = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    dots = F.length(F.regexp_extract("spec", r"^(\.*)", 1))
    parents = F.split(tx.or_else(folder, "."), "/")
    above = F.array_join(F.slice(parents, F.lit(1), F.greatest(F.size(parents) - dots + 1, F.lit(0))), "/")
    dotted = F.regexp_replace(F.col("spec").substr(dots + 1, F.length("spec")), r"\.", "/")
    python_base = F.concat(F.when(dots > 0, above).otherwise(F.lit("")), F.lit("/"), dotted)
    script_base = F.when(F.col("spec").startswith("."), F.concat(folder, F.lit("/"), "spec"))
    base = normalise_path(F.when(F.col("is_python"), python_base).otherwise(script_base))
    candidates = F.transform(
        F.array(*[F.struct(F.lit(n).alias("priority"), F.lit(s).alias("suffix")) for n, s in enumerate(names.MODULE_SUFFIXES)]),
        lambda c: F.struct(c["priority"].alias("priority"), F.concat(F.col("_base"), c["suffix"]).alias("target")),
    )
    exploded = (
        imports.withColumn("_base", base)
        .where(F.col("_base").isNotNull())
        .select("file", "spec", F.explode(candidates).alias("c"))
        .select("file", "spec", "c.priority", "c.target")
    )
    existing = files.select(F.col("file").alias("target"))
    found = ordering.lookup_join(exploded, existing, ["target"], ["file", "spec"])
    return found.groupBy("file", "spec").agg(F.min_by("target", "priority").alias("target"))


# -- evidence budgets --------------------------------------------------------
BATCH, LARGEST_BATCH = 256, 1 << 12


def budget_keys(
    sized: DataFrame, key: str, order: list[str], budget: int, considered: int | None = None, max_kept: int | None = None,
    stop_below: int = 0, used: DataFrame | None = None, batch: int = BATCH,
) -> DataFrame:
    """``(key, order, size, position)`` of the rows that a greedy selection keeps per group; ``sized``: key, order, size.

    Rows that do not fit are skipped, later smaller ones may still fit. ``order`` must be unique within a group. ``used``
    (key, used) is what a group has spent before. ``considered`` cuts groups to their first rows, ``max_kept`` to so many
    kept rows, ``stop_below`` ends the selection once less than that much budget is left; all only where a caller sets them.

    Sizes are evaluated once. A round folds over the next rows of each group that fit what is left, wherever they stand;
    the rows after them that still fit are written for the next round, so each round reads only what may yet be kept.
    Batches grow by rounds, Spark cuts groups to a batch before the shuffle, and rows of size 0, which change nothing, are kept
    without a round. The first row of a batch always fits, so every round gets on.
    """
    narrow = sized.select(key, F.struct(*order).alias("_at"), F.col("size").cast("long").alias("_size"))
    if considered is not None:
        narrow = ordering.smallest_per_group(narrow, [key], [F.col("_at")], considered, "_place").drop("_place")
    start = F.lit(0).cast("long")
    if used is not None:
        narrow = narrow.join(used.select(key, F.col("used").cast("long").alias("_used")), key, "left").withColumn("_used", F.coalesce("_used", start))
    else:
        narrow = narrow.withColumn("_used", start)
    narrow = narrow.withColumn("_n", F.lit(0))
    enough = (F.lit(budget) - F.col("_used") >= stop_below) & (F.col("_n") < F.lit(2**31 - 1 if max_kept is None else max_kept))
    fits = enough & (F.col("_size") <= F.lit(budget) - F.col("_used"))
    rest = stored(narrow.where(fits), "budget")
    parts = []
    if max_kept is None and stop_below <= 0:
        parts.append(rest.where("_size = 0").select(key, "_at", "_size"))
        rest = rest.where("_size > 0")
    at_type = narrow.schema["_at"].dataType.simpleString()

    def take(acc: Column, row: Column) -> Column:
        ok = (acc["used"] + row["_size"] <= budget) & (F.lit(budget) - acc["used"] >= stop_below)
        if max_kept is not None:
            ok = ok & (acc["n"] < max_kept)
        return F.struct(
            F.when(ok, acc["used"] + row["_size"]).otherwise(acc["used"]).alias("used"),
            F.when(ok, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            F.when(ok, F.array_append(acc["kept"], row)).otherwise(acc["kept"]).alias("kept"),
        )

    while not rest.isEmpty():
        first = ordering.smallest_per_group(rest, [key], [F.col("_at")], batch, "_place")
        rows = first.groupBy(key, "_used", "_n").agg(F.array_sort(F.collect_list(F.struct("_at", "_size"))).alias("_rows"))
        empty = F.array().cast(f"array<struct<_at:{at_type},_size:bigint>>")
        folded = rows.select(
            key, F.element_at("_rows", -1)["_at"].alias("_last"), F.aggregate("_rows", F.struct(F.col("_used").alias("used"), F.col("_n").alias("n"), empty.alias("kept")), take).alias("f")
        )
        state = stored(folded.select(key, "_last", F.col("f.used").alias("_used"), F.col("f.n").alias("_n"), "f.kept"), "budget")
        parts.append(state.select(key, F.explode("kept").alias("r")).select(key, "r._at", "r._size"))
        later = rest.select(key, "_at", "_size").join(ordering.broadcast_if_small(state.drop("kept")), key).where((F.col("_at") > F.col("_last")) & fits)
        rest = stored(later.drop("_last"), "budget")
        batch = min(LARGEST_BATCH, 8 * batch)
    if not parts:
        parts.append(rest.select(key, "_at", "_size"))
    kept = parts[0]
    for part in parts[1:]:
        kept = kept.union(part)
    number = F.row_number().over(Window.partitionBy(key).orderBy("_at"))
    return kept.select(key, "_at.*", F.col("_size").alias("size"), number.alias("position"))


def within_budget(
    evidence: DataFrame, key: str, order: list[str], size: Column, budget: int, considered: int | None = None, max_kept: int | None = None,
    stop_below: int = 0, batch: int = BATCH,
) -> DataFrame:
    """The rows of ``evidence`` that ``budget_keys`` keeps, with their ``size`` and ``position`` among the kept of the group."""
    sized = evidence.select(key, *order, size.alias("size"))
    kept = budget_keys(sized, key, order, budget, considered, max_kept, stop_below, batch=batch)
    return evidence.join(kept, [key, *order])


def first_rows(rows: DataFrame, order_col: str, n: int) -> DataFrame:
    """The ``n`` first rows in order, found on the order column alone, so that nothing wide is sorted."""
    last = rows.select(order_col).orderBy(order_col).limit(n).agg(F.max(order_col)).first()[0]
    return rows.where(F.col(order_col) <= F.lit(last))


def prefix_budget(rows: DataFrame, order_col: str, size: Column, budget: int = 60_000, considered: int | None = None, bits: int = ordering.PIECE_BITS) -> DataFrame:
    """The first rows while their running size stays within ``budget``; stops at the first overflow.

    ``order_col`` is a unique long. Sizes are evaluated once, over narrow rows; ``considered`` cuts the rows only where a caller
    sets it. Rows of size 0 go with the rows before them.
    """
    if considered is not None:
        rows = first_rows(rows, order_col, considered)
    sized = stored(rows.select(order_col, size.cast("long").alias("size")), "sizes")
    return rows.join(ordering.running_sum(sized, order_col, "size", "running", budget, bits), order_col)

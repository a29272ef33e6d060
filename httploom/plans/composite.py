"""Composite filter over items, in its fixed order, and the named presets."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators import dedup, filters

LAYOUTS = ["flat", "by_host", "host_first", "site_map", "by_session", "by_time"]


@dataclass(frozen=True)
class Selection:
    """What to keep and how to present it; the defaults keep everything."""

    tools: str = ""
    statuses: str = ""
    dedupe: bool = False
    start: str = ""
    end: str = ""
    parameter_name: str = ""
    parameter_value: str = ""
    parameter_exact: bool = False
    pattern: str = ""
    pattern_target: str = "both"
    scope_only: bool = False
    redact: bool = False
    layout: str = "flat"
    time_layout_host: bool = False
    include_json: bool = True
    include_text: bool = False
    full_analysis: bool = False
    findings: bool = False

    def __post_init__(self):
        if self.layout not in LAYOUTS:
            raise ValueError(f"Unknown layout: {self.layout}")


def steps(selection: Selection, scope: DataFrame | None = None) -> list[tuple[str, object]]:
    """The active steps in order. Deduplication comes after tool and status on purpose: it changes results."""
    s = selection
    if s.scope_only and scope is None:
        raise ValueError("scope_only needs a scope table")
    active = [
        ("scope", lambda df: filters.in_scope(df, scope), s.scope_only),
        ("tool", lambda df: filters.by_tools(df, s.tools), bool(s.tools)),
        ("status", lambda df: filters.by_status(df, s.statuses), bool(s.statuses)),
        ("dedupe", dedup.dedupe, s.dedupe),
        ("time", lambda df: filters.by_time(df, s.start, s.end), bool(s.start or s.end)),
        (
            "parameter",
            lambda df: filters.by_parameter(df, s.parameter_name, s.parameter_value, s.parameter_exact),
            bool(s.parameter_name or s.parameter_value),
        ),
        ("pattern", lambda df: filters.by_regex(df, s.pattern, s.pattern_target), bool(s.pattern)),
    ]
    return [(name, step) for name, step, wanted in active if wanted]


def apply(
    items: DataFrame,
    selection: Selection,
    scope: DataFrame | None = None,
    observations: dict[str, Observation] | None = None,
) -> DataFrame:
    """Filter, number 1..n, tag sessions, then redact (tags are taken before masking, so buckets survive).

    With ``observations``, every step's row count is collected while the job runs.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        if observations is None:
            return df
        observations[name] = Observation(name)
        return df.observe(observations[name], F.count(F.lit(1)).alias("items"))

    kept = counted(items, "input")
    for name, step in steps(selection, scope):
        kept = counted(kept.transform(step), name)
    kept = dedup.tag_sessions(dedup.reindex(kept))
    return dedup.redact_items(kept) if selection.redact else kept


_TREE = Selection(layout="site_map", dedupe=True)
_TRIAGE = replace(_TREE, statuses="401,403,5xx")
_MASKED = replace(_TREE, redact=True)

# Named selections: (group, label) -> Selection.
PRESETS: dict[tuple[str, str], Selection] = {
    ("review", "json"): replace(_TREE, full_analysis=True),
    ("review", "json+text"): replace(_TREE, full_analysis=True, include_text=True),
    ("format", "json"): _TREE,
    ("format", "text"): replace(_TREE, include_json=False, include_text=True),
    ("format", "json+text"): replace(_TREE, include_text=True),
    ("layout", "flat"): replace(_TREE, layout="flat"),
    ("layout", "by_host"): replace(_TREE, layout="by_host"),
    ("layout", "host_first"): replace(_TREE, layout="host_first"),
    ("layout", "by_session"): replace(_TREE, layout="by_session"),
    ("layout", "by_time"): replace(_TREE, layout="by_time"),
    ("triage", "json"): _TRIAGE,
    ("triage", "json+text"): replace(_TRIAGE, include_text=True),
    ("redacted", "json"): _MASKED,
    ("redacted", "json+text"): replace(_MASKED, include_text=True),
    ("redacted", "by_session"): replace(_MASKED, layout="by_session"),
    ("scope", "json"): replace(_TREE, full_analysis=True, scope_only=True),
    ("quick", "review"): replace(_TREE, full_analysis=True),
    ("quick", "json"): _TREE,
    ("quick", "json+text+findings"): replace(_TREE, include_text=True, findings=True),
    ("quick", "triage"): _TRIAGE,
    ("quick", "redacted"): replace(_MASKED, layout="by_session"),
}


def preset(group: str, label: str) -> Selection:
    try:
        return PRESETS[(group, label)]
    except KeyError:
        raise ValueError(f"Unknown preset: {group}/{label}") from None

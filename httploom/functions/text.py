"""Small text expressions shared by the other function modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITESPACE = " \t\r\n\f\x0b"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def or_else(text: Column, fallback: str) -> Column:
    """The text, or ``fallback`` where it is empty or null."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(fallback))


def before(text: Column, sep: str) -> Column:
    """Everything before the first ``sep`` (the whole text where it does not occur)."""
    return F.substring_index(text, sep, 1)


def after(text: Column, sep: str) -> Column:
    """Everything after the first ``sep`` (empty where it does not occur)."""
    cut = F.length(F.substring_index(text, sep, 1)) + F.lit(len(sep) + 1)
    return text.substr(cut, F.length(text))


def bounded(text: Column, limit: int) -> Column:
    """``struct(text, truncated)`` with at most ``limit`` characters kept."""
    return F.struct(F.substring(text, 1, limit).alias("text"), (F.length(text) > limit).alias("truncated"))


def content_id(prefix: str, text: Column) -> Column:
    """Stable short id: the prefix and 12 hex digits of the content hash."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text.cast("binary"), 256), 1, 12))


def first_label(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Label of the first matching pattern, null when none matches; stops at the first hit."""
    out = F.when(text.rlike(patterns[0][0]), F.lit(patterns[0][1]))
    for pattern, label in patterns[1:]:
        out = out.when(text.rlike(pattern), F.lit(label))
    return out


def csv_values(text: str) -> list[str]:
    """Comma-separated parameter text as distinct lower-case values."""
    return sorted({part.strip().lower() for part in (text or "").split(",") if part.strip()})


def digest_key(*columns: Column) -> Column:
    """Fixed-width grouping key for long composite text keys (length-prefixed, so unambiguous)."""
    parts = []
    for column in columns:
        value = F.coalesce(column, F.lit(""))
        parts += [F.length(value).cast("string"), F.lit(":"), value]
    return F.sha2(F.concat(*parts).cast("binary"), 256)

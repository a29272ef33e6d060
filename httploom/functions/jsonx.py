"""JSON helpers. Top-level access is JVM-side; unbounded recursion is an Arrow-batched UDF."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import HEADERS
from . import text as tx


def is_container(text: Column) -> Column:
    return tx.strip(text).rlike(r"^[\[{]")


def is_valid(text: Column) -> Column:
    """Whether the text is JSON of any kind. Failed parses are costly, so impossible starts skip the parser."""
    possible = tx.strip(text).rlike(r"^[\[{\"\-0-9tfn]")
    return F.when(possible, F.try_parse_json(text).isNotNull()).otherwise(F.lit(False))


def entries(text: Column) -> Column:
    """Top-level members of a JSON object as ``array<struct<key, kind, value>>``; null otherwise."""
    members = F.from_json(F.when(tx.strip(text).startswith("{"), text), "map<string,variant>")
    return F.transform(
        F.map_entries(members),
        lambda e: F.struct(
            e["key"].alias("key"), F.schema_of_variant(e["value"]).alias("kind"), e["value"].cast("string").alias("value")
        ),
    )


def object_keys(text: Column) -> Column:
    """Distinct top-level keys of a JSON object; an empty array for anything else."""
    keys = F.json_object_keys(F.when(tx.strip(text).startswith("{") & is_valid(text), text))
    return F.coalesce(F.array_distinct(keys), F.array().cast("array<string>"))


def is_int_or_text(kind: Column) -> Column:
    return kind.isin("BIGINT", "STRING", "BOOLEAN") | kind.rlike(r"^DECIMAL\(\d+,0\)$")


# -- trees (task-side helpers; none recurses, so depth costs memory only) ------
class Verbatim(str):
    """A number kept as it was written."""


_TOKEN = re.compile(r'[ \t\n\r]*(?:([{}\[\]:,])|(")|([^ \t\n\r{}\[\]:,"]+))')
_LONG_INTEGER = 4000  # digits; Python refuses to convert more than 4,300


def integer(text: str) -> int | Verbatim:
    return int(text) if len(text) <= _LONG_INTEGER else Verbatim(text)


@functools.cache
def _decoder(whole: Callable, fraction: Callable) -> json.JSONDecoder:
    return json.JSONDecoder(parse_int=whole, parse_float=fraction)


def parse(text: str, whole: Callable = integer, fraction: Callable = float) -> object:
    """The tree of a JSON text of any depth; ValueError for other texts."""
    try:
        return _decoder(whole, fraction).decode(text)
    except RecursionError:
        return _parse_deep(text, whole, fraction)


def _parse_deep(text: str, whole: Callable, fraction: Callable) -> object:
    """``json.loads`` with the open containers on a list instead of the call stack."""
    root: list = []
    containers: list = [root]
    keys: list = [None]  # of the value that comes next, per open container
    allowed, at, end = "value", 0, len(text.rstrip(" \t\n\r"))

    def put(value: object) -> None:
        if isinstance(containers[-1], dict):
            containers[-1][keys[-1]] = value
        else:
            containers[-1].append(value)

    while at < end:
        found = _TOKEN.match(text, at)
        if found is None or allowed == "nothing":
            raise ValueError(f"no JSON at {at}")
        mark, quote, word = found.groups()
        at = found.end()
        if mark and mark in "]}":
            fits = isinstance(containers[-1], dict) if mark == "}" else isinstance(containers[-1], list) and len(containers) > 1
            if not fits or allowed not in ("next", "value or end", "key or end"):
                raise ValueError(f"{mark} does not fit at {at}")
            containers.pop()
            keys.pop()
            allowed = "next"
        elif mark == ":" and allowed == "colon":
            allowed = "value"
        elif mark == "," and allowed == "next":
            allowed = "key" if isinstance(containers[-1], dict) else "value"
        elif quote and allowed in ("key", "key or end"):
            keys[-1], at = json.decoder.scanstring(text, at)
            allowed = "colon"
        elif mark and mark in "[{" and allowed in ("value", "value or end"):
            node: dict | list = {} if mark == "{" else []
            put(node)
            containers.append(node)
            keys.append(None)
            allowed = "key or end" if mark == "{" else "value or end"
        elif (quote or word) and allowed in ("value", "value or end"):
            if quote:
                value, at = json.decoder.scanstring(text, at)
            else:
                value = json.loads(word, parse_int=whole, parse_float=fraction)
            put(value)
            allowed = "next"
        else:
            raise ValueError(f"no JSON at {at}")
        if allowed == "next" and len(containers) == 1:
            allowed = "nothing"
    if len(containers) > 1 or not root:
        raise ValueError("the JSON text breaks off")
    return root[0]


def write(tree: object, parts_of: Callable[[object], list]) -> str:
    """Text of a tree: ``parts_of(node)`` lists strings to write and ``(child,)`` tuples to expand in their place."""
    out: list[str] = []
    waiting: list = [(tree,)]
    while waiting:
        part = waiting.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            waiting.extend(reversed(parts_of(part[0])))
    return "".join(out)


def between(parts: list[list], opening: str, closing: str) -> list:
    """Parts of a container around the comma-separated parts of its members."""
    out: list = [opening]
    for number, member in enumerate(parts):
        out += [", ", *member] if number else member
    return [*out, closing]


_scalar = json.JSONEncoder(ensure_ascii=False).encode


def scalar_text(value: object) -> str:
    return str(value) if isinstance(value, Verbatim) or type(value) is int else _scalar(value)


def _members(tree: object, list_sample: int | None) -> Iterator[tuple[tuple, str, str]]:
    """``(trail, own name, value)`` of every scalar member in document order; trails are linked (parent, step)."""
    waiting: list = [(None, None, tree)]
    while waiting:
        trail, name, node = waiting.pop()
        if isinstance(node, dict):
            waiting.extend(((trail, k), k, v) for k, v in reversed(node.items()))
        elif isinstance(node, list):
            taken = len(node) if list_sample is None else min(list_sample, len(node))
            waiting.extend(((trail, n), None, node[n]) for n in range(taken - 1, -1, -1))
        elif name is not None:
            yield trail, name, node if isinstance(node, str) else json.dumps(node)


def _dotted(trail: tuple | None) -> str:
    steps = []
    while trail is not None:
        trail, step = trail
        steps.append(f"[{step}]" if isinstance(step, int) else f".{step}")
    return "".join(reversed(steps)).removeprefix(".")


def _listed(bodies: pd.Series, named: Callable[[tuple, str], str], list_sample: int | None) -> pd.Series:
    def one(text):
        try:
            # Numbers stay as written, so that 1.50 and 1e3 stay 1.50 and 1e3.
            tree = parse(text, str, str) if text is not None else None
        except ValueError:
            return []
        return [{"name": named(trail, name), "value": value} for trail, name, value in _members(tree, list_sample)]

    return bodies.map(one, na_action=None)


def flatten(text: Column, list_sample: int | None = None) -> Column:
    """Dotted path / value pairs of a JSON body; non-JSON rows never leave the JVM.

    ``list_sample`` walks only so many elements of each list; by default all are walked.
    """

    @F.pandas_udf(HEADERS)
    def flattened(bodies: pd.Series) -> pd.Series:
        return _listed(bodies, lambda trail, name: _dotted(trail), list_sample)

    return flattened(F.when(is_container(text), text))


def members(text: Column) -> Column:
    """Own name / value of every scalar member at any depth."""

    @F.pandas_udf(HEADERS)
    def listed(bodies: pd.Series) -> pd.Series:
        return _listed(bodies, lambda trail, name: name, None)

    return listed(F.when(is_container(text), text))


_KINDS = {bool: "boolean", int: "integer", Verbatim: "integer", float: "number", str: "string"}


def _schema_parts(node: object) -> list:
    if isinstance(node, dict):
        properties = [[json.dumps(k) + ": ", (v,)] for k, v in node.items()]
        return between(properties, '{"type": "object", "properties": {', "}}")
    if isinstance(node, list):
        return ['{"type": "array", "items": ', (node[0],) if node else "{}", "}"]
    return ['{"nullable": true}' if node is None else f'{{"type": "{_KINDS[type(node)]}"}}']


@F.pandas_udf(T.StringType())
def _api_schema(bodies: pd.Series) -> pd.Series:
    def one(text):
        try:
            return write(parse(text), _schema_parts) if text else None
        except ValueError:
            return None

    return bodies.map(one, na_action=None)


def api_schema(text: Column) -> Column:
    """Type description of one sample body (arrays by their first element) as JSON text."""
    return _api_schema(text)


@F.pandas_udf(T.StringType())
def _substitute(bodies: pd.Series, keys: pd.Series, values: pd.Series) -> pd.Series:
    def one(text, key, value):
        if text is None:
            return None
        try:
            tree = json.loads(text)
        except ValueError:
            return text
        if not isinstance(tree, dict) or key not in tree:
            return text
        numeric = isinstance(tree[key], int) and not isinstance(tree[key], bool)
        digits = value[1:] if value.startswith("-") else value
        tree[key] = int(value) if numeric and digits.isascii() and digits.isdigit() else value
        return json.dumps(tree)

    return pd.Series([one(*row) for row in zip(bodies, keys, values)], dtype=object)


def substitute(text: Column, key: Column, value: Column, where: Column) -> Column:
    """Replace one top-level member, numbers staying numbers; only ``where`` rows are shipped."""
    return _substitute(*[F.when(where, c) for c in (text, key, value)])

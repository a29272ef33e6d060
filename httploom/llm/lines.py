"""Line dedup with a log-template tree.

A line's path in the tree has fixed depth: its token count, then its leading tokens, where tokens that carry digits
are generalised. In a leaf, lines join the first template that agrees with enough of their tokens; positions that
differ become variable fields. Lines of templates that recur in many documents are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from httploom.session import scratch

from . import base

DEPTH = 4
SIMILAR = 0.7
MIN_DOCS = 10
COPY_SHARE = 8 / 9  # shared characters of two documents that are 0.8 similar, which the near-duplicate stage joins
_DIGIT = re.compile(r"[0-9]")
_FIELD = "<*>"


def generalise(line: str) -> list[str]:
    """Tokens of a line; those with a digit are a variable field."""
    tokens = line.split()
    return [_FIELD if _DIGIT.search(t) else t for t in tokens] if _DIGIT.search(line) else tokens


def _hash(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode())
    return value - (1 << 64) if value >> 63 else value


def leaf_of(tokens: list[str], depth: int = DEPTH) -> int:
    return _hash("\n".join([str(len(tokens)), *tokens[:depth]]))


def _leaves(batches, depth: int):
    """The distinct leaves of each document."""
    for batch in base.slices(batches, text=0):
        out: list[int] = []
        for text in batch.column(0).to_pylist():
            out.extend({leaf_of(t, depth) for t in map(generalise, text.split("\n")) if t})
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], ["leaf"])


def _lines(batches, depth: int):
    """The distinct generalised lines of each document row, its hash (``row``) and their share of its characters."""
    for batch in base.slices(batches):
        places, leaves, hashes, lines, shares = [], [], [], [], []
        for at, text in enumerate(batch.column(1).to_pylist()):
            raw = text.split("\n")
            found: dict[str, list] = {}
            for line in raw:
                if tokens := generalise(line):
                    found.setdefault(" ".join(tokens), [tokens, 0])[1] += len(line)
            total = sum(map(len, raw))
            for line, (tokens, size) in found.items():
                places.append(at)
                leaves.append(leaf_of(tokens, depth))
                hashes.append(_hash(line))
                lines.append(line)
                shares.append(size / total)
        taken = pa.array(places, pa.int64())
        longs = (pa.array(v, pa.int64()) for v in (leaves, hashes))
        columns = [batch.column(0).take(taken), *longs, pa.array(lines, pa.string()), batch.column(2).take(taken), pa.array(shares, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, ["id", "leaf", "hash", "line", "row", "share"])


class Leaf:
    """Templates of one leaf; all its lines have the same number of tokens and the same ``depth`` leading ones.

    A template is compared by its first line, which stays as it is, so a line's template depends on the order of the lines
    alone and not on the pieces they come in. Positions where members differ from it are the variable fields.

    Where a line may differ from its template in so many tokens, the two agree at one at least of any positions that are one
    more. So templates are found by the line's rarest tokens, and only those that share one with it are compared with it.
    """

    def __init__(self, similar: float, depth: int = DEPTH):
        self.similar, self.depth = similar, depth
        self.templates: list[list[str]] = []
        self.names: list[int] = []
        self.holders: dict[tuple[int, str], list[int]] = {}  # templates by position and token

    def place(self, lines: list[str], hashes: list[int]) -> list[int]:
        """Template id of each line: the first template, in order of appearance, that it is similar to."""
        out = []
        for line, value in zip(lines, hashes):
            tokens = line.split(" ")
            size = len(tokens)
            apart = next(k for k in range(size, -1, -1) if (size - k) / size >= self.similar)  # tokens that may differ
            held = [self.holders.get((at, tokens[at]), ()) for at in range(min(self.depth, size), size)]
            if apart >= len(held):
                met = range(min(1, len(self.templates)))  # whatever follows the common head, the line is similar enough
            else:
                met = sorted(set().union(*sorted(held, key=len)[: apart + 1]))
            found = next((t for t in met if sum(map(eq, tokens, self.templates[t])) / size >= self.similar), None)
            if found is None:
                found = len(self.templates)
                self.templates.append(tokens)
                self.names.append(value)
                for at in range(min(self.depth, size), size):
                    self.holders.setdefault((at, tokens[at]), []).append(found)
            out.append(self.names[found])
        return out


def _templates(batches, similar: float, depth: int = DEPTH) -> Iterator[pa.RecordBatch]:
    """Template of each distinct line; rows come sorted by leaf, so one leaf's templates are held at a time."""
    open_leaf, leaf = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(0))
        lines, hashes, found = batch.column(2).to_pylist(), batch.column(1).to_pylist(), []
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            if leaf is None or keys[a] != open_leaf:
                open_leaf, leaf = keys[a], Leaf(similar, depth)
            found.extend(leaf.place(lines[a:b], hashes[a:b]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["leaf", "hash", "template"])


def _joinable(df: DataFrame, row_bytes: int) -> DataFrame:
    """Broadcast while small; more rows join by shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= base.BROADCAST_BYTES else df


def recurring(
    rows: DataFrame, min_docs: int = MIN_DOCS, depth: int = DEPTH, similar: float = SIMILAR
) -> tuple[DataFrame, DataFrame]:
    """``(lines, hashes)`` for ``(id, text)`` rows.

    ``lines`` are the distinct generalised lines ``(id, leaf, hash, line, row, share)`` of each row, as far as their leaf is reached
    by ``min_docs`` rows: in other leaves no template can recur. ``hashes`` are ``(hash, template, n_docs)`` of the lines
    whose template occurs in ``min_docs`` documents.
    """
    spark = rows.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    reached = rows.select("text").mapInArrow(base.packaged(_leaves, depth=depth), "leaf long").groupBy("leaf").count()
    leaves = stored(reached.where(F.col("count") >= min_docs).select("leaf"), "leaves")
    schema = T.StructType(
        [
            rows.schema["id"],
            T.StructField("leaf", T.LongType()),
            T.StructField("hash", T.LongType()),
            T.StructField("line", T.StringType()),
            T.StructField("row", T.LongType()),
            T.StructField("share", T.DoubleType()),
        ]
    )
    numbered = rows.select("id", "text", F.xxhash64("text").alias("row"))
    lines = stored(numbered.mapInArrow(base.packaged(_lines, depth=depth), schema).join(_joinable(leaves, 16), "leaf", "left_semi"), "lines")
    distinct = lines.select("leaf", "hash", "line").distinct()
    ordered = distinct.repartition("leaf").sortWithinPartitions("leaf", "line", "hash").select("leaf", "hash", "line")
    placed = stored(ordered.mapInArrow(base.packaged(_templates, similar=similar, depth=depth), "leaf long, hash long, template long"), "templates")
    at = lines.select("id", "leaf", "hash").join(_joinable(placed, 32), ["leaf", "hash"])
    frequent = (
        at.groupBy("leaf", "template").agg(F.count_distinct(F.struct("id")).alias("n_docs")).where(F.col("n_docs") >= min_docs)
    )
    return lines, placed.join(frequent, ["leaf", "template"]).select("hash", "template", "n_docs")


def copied(lines: DataFrame, hashes: DataFrame, copy_share: float) -> DataFrame:
    """``(template)`` of recurring lines that are copied text: most of the different texts that hold them are copies.

    A copy is a text whose recurring lines hold ``copy_share`` of its characters or more. Boilerplate stands in other
    documents too, and stays boilerplate in a short document that it fills.
    """
    held = lines.select("row", "hash", "share").distinct().join(_joinable(hashes.select("hash", "template"), 24), "hash")
    copy = (F.sum("share").over(Window.partitionBy("row")) >= copy_share - 1e-9).cast("int")
    judged = held.select("row", "template", copy.alias("copy")).groupBy("template").agg(F.avg("copy").alias("copies"))
    return judged.where("copies > 0.5").select("template")


KEPT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("n_lines", T.LongType()),
        T.StructField("n_dropped", T.LongType()),
        T.StructField("n_recurring", T.LongType()),
    ]
)


def strip(text: str | None, hashes: list[int] | None) -> tuple[str | None, int, int]:
    """Text without the lines of these hashes, its number of lines with a word, of lines dropped."""
    lines = [] if text is None else text.split("\n")
    tokens = [generalise(line) for line in lines]
    filled = sum(map(bool, tokens))
    if not hashes:
        return text, filled, 0
    gone = set(hashes)
    out = [bool(t) and _hash(" ".join(t)) in gone for t in tokens]
    return "\n".join(line for line, o in zip(lines, out) if not o), filled, sum(out)


def _strip(batches, text_at: int, into: str):
    for batch in base.slices(batches, text=text_at):
        hashes = batch.column(batch.num_columns - 1).to_pylist()
        rows = [(*found, found[2]) for found in map(strip, batch.column(text_at).to_pylist(), hashes)]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
        kept = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], KEPT.names)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-2], kept], [*batch.schema.names[:-2], into])


def drop_recurring(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    depth: int = DEPTH,
    similar: float = SIMILAR,
    copy_share: float = COPY_SHARE,
    into: str = "_lines",
) -> DataFrame:
    """Rows of ``docs`` with a struct ``into``: ``text`` without recurring lines, ``n_lines``, ``n_dropped``, ``n_recurring``.

    A line recurs if its template occurs in ``min_docs`` documents and is not copied text (see ``copied``); it goes from
    every document, so ``n_recurring`` and ``n_dropped`` are equal. Copies of a text keep it for the near-duplicate stage,
    which leaves one of them; otherwise all of them would lose it at once.

    The tree is built from distinct lines, and only from leaves that enough documents reach, so prose never
    leaves its task; counts are map-side-combined. A leaf's lines stream through one task against its templates
    (first match in line order).

    Null text stays null and has no lines; empty and blank lines are kept and never recur; null ids count as one
    document, as do repeated rows of an id; an empty table gives no rows; a column of ``docs`` named ``into`` is
    replaced, no other can clash.
    """
    docs = docs.drop(into)
    marks, own_id = base.free_names(docs, "_recurring", "_id")
    rows = base.keyed_text(docs, id_col, text_col)
    lines, hashes = recurring(rows, min_docs, depth, similar)
    path = scratch(docs.sparkSession, "boilerplate")
    hashes.join(copied(lines, hashes, copy_share), "template", "left_anti").write.parquet(path)
    hashes = docs.sparkSession.read.parquet(path)
    marked = lines.select("id", "hash").join(_joinable(hashes.select("hash").distinct(), 16), "hash", "left_semi")
    by_doc = marked.groupBy("id").agg(F.collect_set("hash").alias(marks)).withColumnRenamed("id", own_id)
    joined = docs.join(by_doc, docs[id_col].eqNullSafe(by_doc[own_id]), "left").select(*docs.columns, own_id, marks)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, KEPT)])
    return joined.mapInArrow(base.packaged(_strip, text_at=docs.columns.index(text_col), into=into), schema)

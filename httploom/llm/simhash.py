"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into blocks. Two fingerprints that differ in at most ``distance`` bits agree on all but that many
blocks, so they share the key of some choice of blocks. Fingerprints meet on those keys, distances are verified, and
connected components of the links are the groups.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from httploom.session import scratch

from . import base

BITS = 64
DISTANCE = 4
SHINGLE = 4
SEED = 42
_ALL_PAIRS = 256  # fingerprints of a key that are compared at once
_CHUNK = 1 << 15  # shingles whose bits are counted at a time
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED, n_parts: int = 1) -> np.ndarray:
    """SimHash of the word shingles (repeats count), A-Z lower-cased, in ``n_parts`` 64-bit parts; 0 without words.

    One part takes XXH64 of each shingle, two take the 128 bits of XXH3.
    """
    words = _WORD.findall(text.encode().lower())
    if not words:
        return np.zeros(n_parts, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    size = min(shingle, len(words))
    stops = ends[size - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    total = np.zeros(BITS * n_parts, np.int64)
    wide = n_parts == 2
    digest = xxhash.xxh3_128_digest if wide else xxhash.xxh64_intdigest
    for at in range(0, len(stops), _CHUNK):
        pairs = zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])
        found = [digest(joined[a:b], seed) for a, b in pairs]
        raw = np.frombuffer(b"".join(found), np.uint8) if wide else np.array(found, "<u8").view(np.uint8)
        total += np.unpackbits(raw.reshape(-1, 8 * n_parts), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(stops)).astype(np.uint8)
    return np.packbits(bits, bitorder="little").view("<u8")


def _fingerprints(batches, shingle: int, seed: int, n_parts: int):
    for batch in base.slices(batches):
        values = np.array([fingerprint(t, shingle, seed, n_parts) for t in batch.column(1).to_pylist()]).view(np.int64)
        parts = [pa.array(np.ascontiguousarray(values[:, k])) for k in range(n_parts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *parts], ["id", *_parts(n_parts)])


def _parts(n_parts: int) -> list[str]:
    return [f"fp{k}" for k in range(n_parts)]


def fingerprints(
    docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, seed: int = SEED, n_parts: int = 1
) -> DataFrame:
    """``(id, fp0[, fp1])`` per document row; each part holds 64 bits as a signed long."""
    rows = base.keyed_text(docs, id_col, text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{p} long" for p in _parts(n_parts))
    return rows.mapInArrow(base.packaged(_fingerprints, shingle=shingle, seed=seed, n_parts=n_parts), schema)


def plan_blocks(count: int, distance: int = DISTANCE, load: int = 64) -> list[int]:
    """Masks of the block choices to join on, for ``count`` distinct fingerprints.

    With ``distance + extra`` blocks, some ``extra`` of them agree. More extra blocks mean longer keys, and so fewer
    chance meetings, but more keys; the fewest that leave about ``load`` fingerprints a key are taken. Every plan finds
    the same links.
    """
    for extra in range(1, 7):
        n_blocks = distance + extra
        edges = [round(BITS * k / n_blocks) for k in range(n_blocks + 1)]
        blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
        masks = [sum(chosen) for chosen in combinations(blocks, extra)]
        if count <= load << min(mask.bit_count() for mask in masks):
            break
    return masks


def _columns(batch: pa.RecordBatch, start: int) -> np.ndarray:
    """Longs from column ``start`` on as rows of unsigned parts."""
    return np.stack([np.asarray(c) for c in batch.columns[start:]], axis=1).view(np.uint64)


def _keys(batches, masks: list[int], names: list[str]):
    """Rows (key, node, parts): per part and mask a mixed hash of the masked bits and their place."""
    wide = np.array(masks, np.uint64)
    for batch in batches:
        node, fp = np.asarray(batch.column(0)), _columns(batch, 1)
        keys = []
        for part in range(fp.shape[1]):
            salt = np.arange(1 + part * len(masks), 1 + (part + 1) * len(masks), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            key = (fp[:, part, None] & wide) ^ salt
            key = (key ^ (key >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            keys.append(key ^ (key >> np.uint64(29)))
        key = np.concatenate(keys, axis=1)
        repeated = np.repeat(np.column_stack([node.view(np.uint64), fp]), key.shape[1], axis=0).view(np.int64)
        columns = [key.ravel().view(np.int64), *(np.ascontiguousarray(c) for c in repeated.T)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _close(left: np.ndarray, right: np.ndarray, distance: int, block_distance: int) -> np.ndarray:
    """Whether fingerprints (rows of parts) differ in few bits in all, and in few enough in one part to be sure to meet."""
    bits = np.bitwise_count(left ^ right)
    if bits.shape[-1] == 1:
        return bits[..., 0] <= distance
    return (bits.sum(axis=-1, dtype=np.int64) <= distance) & (bits.min(axis=-1) <= block_distance)


def spanning_links(fps: np.ndarray, distance: int, block_distance: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of links that connect everything that chains of close pairs connect among the rows of ``fps``.

    A search that drops each fingerprint from the rest once it is reached: a dense group costs little more than its
    size, and no group gives more links than it has members.
    """
    if len(fps) <= _ALL_PAIRS:
        a, b = np.nonzero(np.triu(_close(fps[:, None], fps[None], distance, block_distance), 1))
        if len(a) < len(fps):
            return a, b
    rest = np.arange(len(fps))
    left, right = [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            near = _close(fps[rest], fps[here], distance, block_distance)
            if near.any():
                reached = rest[near]
                left.append(np.full(len(reached), here))
                right.append(reached)
                queue.extend(reached.tolist())
                rest = rest[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _links(batches, distance: int, block_distance: int) -> Iterator[pa.RecordBatch]:
    """Links within each key; the rows come sorted by key, so one key's fingerprints are held at a time."""
    open_key, parts = None, []

    def finish() -> tuple[np.ndarray, np.ndarray]:
        rows = np.concatenate(parts)
        a, b = spanning_links(rows[:, 1:], distance, block_distance)
        return rows[a, 0], rows[b, 0]

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, rows = np.asarray(batch.column(0)), _columns(batch, 1)
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        left, right = [], []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if parts and keys[a] != open_key:
                if len(parts) > 1 or len(parts[0]) > 1:
                    x, y = finish()
                    left.append(x)
                    right.append(y)
                parts = []
            open_key = keys[a]
            parts.append(rows[a:b])
        if left:
            yield _link_batch(np.concatenate(left), np.concatenate(right))
    if parts:
        yield _link_batch(*finish())


def _link_batch(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    a, b = left.view(np.int64), right.view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def links(distinct: DataFrame, masks: list[int], distance: int = DISTANCE, block_distance: int | None = None) -> DataFrame:
    """``(a, b)`` nodes whose fingerprints are close, enough of them to connect all that are connected.

    ``distinct`` has ``node`` and the parts of distinct fingerprints.
    """
    names = [c for c in distinct.columns if c.startswith("fp")]
    block_distance = distance if block_distance is None else block_distance
    out = ["key", "node", *names]
    keyed = distinct.select("node", *names).mapInArrow(base.packaged(_keys, masks=masks, names=out), ", ".join(f"{c} long" for c in out))
    ordered = keyed.repartition("key").sortWithinPartitions("key", "node")
    return ordered.mapInArrow(base.packaged(_links, distance=distance, block_distance=block_distance), "a long, b long").distinct()


def components(spark: SparkSession, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)``: the smallest node of each connected component, for all nodes that have a link.

    Large-star and small-star rounds until nothing changes; every round is a written table, so lineage stays short and
    a lost executor costs one round at most.
    """

    def stored(df: DataFrame) -> DataFrame:
        path = scratch(spark, "links")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def star(pairs: DataFrame, keep) -> DataFrame:
        """Tie every kept neighbour of a node to the node's smallest neighbour (or itself)."""
        least = pairs.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        return pairs.join(least, "a").where(keep).select(F.col("b").alias("a"), F.col("least").alias("b"))

    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    current = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    for _ in range(rounds):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both, F.col("b") > F.col("a")).where("a <> b").distinct()
        # Now every pair points from the larger to the smaller node.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("least"))
        small = (
            down.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("p"))
            .select("p.a", "p.b")
            .where("a <> b")
            .distinct()
        )
        current = stored(small)
        state = current.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def keep_first(marked: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of ``marked`` (rows with their ``_node``) per component: smallest id, null ids last, then smallest text hash.

    ``roots`` are the ``(node, root)`` of nodes that have a link; any other node is a component of its own. Rows that repeat
    id and text give one row. Columns ``_digest``, ``_id``, ``_n``, ``_first`` are used inside.
    """
    columns = marked.columns
    rows = marked.withColumn("_digest", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    counted = rows.groupBy("_node", F.col(id_col).alias("_id"), "_digest").agg(F.count(F.lit(1)).alias("_n"))
    order = F.struct(F.col("_id").isNull().alias("none"), "_id", "_digest", "_node", "_n")
    # One row per node first, so that the many copies of one text do not meet in the join.
    nodes = counted.groupBy("_node").agg(F.min(order).alias("_first"))
    rooted = nodes.join(roots.withColumnRenamed("node", "_node"), "_node", "left").select(F.coalesce("root", "_node").alias("root"), "_first")
    first = rooted.groupBy("root").agg(F.min("_first").alias("_first")).select("_first.*")
    same = (rows["_node"] == first["_node"]) & rows[id_col].eqNullSafe(first["_id"]) & (rows["_digest"] == first["_digest"])
    kept = rows.join(first, same).select(*[rows[c] for c in columns], first["_n"])
    single = kept.where("_n = 1").select(*columns)
    return single.unionByName(kept.where("_n > 1").select(*columns).dropDuplicates(["_node"]))


def _with_node(batches, text_at: int, shingle: int, seed: int, n_parts: int):
    for batch in base.slices(batches, text=text_at):
        texts = batch.column(text_at).to_pylist()
        values = np.array([fingerprint(t or "", shingle, seed, n_parts) for t in texts]).view(np.int64)
        parts = [pa.array(np.ascontiguousarray(values[:, k])) for k in range(n_parts)]
        yield pa.RecordBatch.from_arrays([*batch.columns, *parts], [*batch.schema.names, *(f"_{p}" for p in _parts(n_parts))])


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = DISTANCE,
    shingle: int = SHINGLE,
    seed: int = SEED,
    n_parts: int = 1,
    block_distance: int | None = None,
) -> DataFrame:
    """One row of ``docs`` per near-duplicate group of ``near_duplicates``, whatever ids its rows have (see ``keep_first``).

    Columns of ``docs`` may have any names.
    """
    spark, given = docs.sparkSession, docs.columns
    docs, (id_col, text_col) = base.numbered_columns(docs, id_col, text_col)
    names = _parts(n_parts)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"_{p}", T.LongType()) for p in names)])
    run = base.packaged(_with_node, text_at=docs.columns.index(text_col), shingle=shingle, seed=seed, n_parts=n_parts)
    node = F.col("_fp0") if n_parts == 1 else F.xxhash64(*(f"_{p}" for p in names))
    path = scratch(spark, "fingerprints")
    docs.mapInArrow(run, schema).withColumn("_node", node).write.parquet(path)
    marked = spark.read.parquet(path)
    distinct = marked.select(F.col("_node").alias("node"), *(F.col(f"_{p}").alias(p) for p in names)).distinct()
    block_distance = distance if block_distance is None else block_distance
    roots = components(spark, links(distinct, plan_blocks(distinct.count(), block_distance), distance, block_distance))
    return keep_first(marked, roots, id_col, text_col).select(*docs.columns).toDF(*given)


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    distance: int = DISTANCE,
    shingle: int = SHINGLE,
    seed: int = SEED,
    n_parts: int = 1,
    block_distance: int | None = None,
) -> DataFrame:
    """``(id, fingerprint, component_id)`` per document row; ``component_id`` is the smallest id of the group.

    Documents are linked where their fingerprints of ``64 * n_parts`` bits differ in at most ``distance`` bits and, with
    two parts, in at most ``block_distance`` bits of one of them: pigeonhole keys are taken from each part, and
    two fingerprints within ``2 * block_distance + 1`` bits always meet.

    Equal texts collapse to one fingerprint before any join, so copies cost one row per task. Links are found among
    distinct fingerprints and verified; a key shared by many of them gives at most one link per member. Fingerprints
    are computed once and kept in a table below the shared root.

    Null, empty and blank texts have fingerprint 0 and are linked like any other; null ids get the component of the
    others in their group, or null; repeated rows give repeated rows; an empty table gives no rows; other columns are
    ignored.
    """
    spark = docs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    block_distance = distance if block_distance is None else block_distance
    names = _parts(n_parts)
    node = F.col("fp0") if n_parts == 1 else F.xxhash64(*names)
    found = stored(fingerprints(docs, id_col, text_col, shingle, seed, n_parts).withColumn("node", node), "fingerprints")
    distinct = found.groupBy("node", *names).agg(F.min("id").alias("first"))
    masks = plan_blocks(distinct.count(), block_distance)
    groups = components(spark, links(distinct, masks, distance, block_distance))
    rooted = stored(distinct.join(groups, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "roots")
    # Tables of their own, so that Spark can split a hot group, or the many copies of one text, in the joins after them.
    named = stored(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "groups")
    by_node = stored(rooted.join(named, "root").groupBy("node").agg(F.min("component_id").alias("component_id")), "nodes")
    text = F.concat(*[F.lower(F.lpad(F.hex(p), 16, "0")) for p in reversed(names)])
    return found.join(by_node, "node").select(F.col("id").alias(id_col), text.alias("fingerprint"), "component_id")

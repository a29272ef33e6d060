"""Near-duplicates by exact similarity: pairs meet on SimHash blocks or MinHash bands and are verified on their shingle sets.

The similarity of two documents is the Jaccard similarity of their sets of word shingles. Close SimHash fingerprints are found
by the operator (``simhash.links``); they miss many pairs near the limit, so pairs meet on MinHash bands too. A key of those is
made of the smallest permuted hashes of a band; a pair of similarity ``s`` misses all bands with probability
``(1 - s ** ROWS) ** BANDS``, which is 3.2e-6 at 0.8. Whatever meets is verified, so no pair below the limit is linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from httploom.session import scratch

from . import base, lines, simhash

SIMILAR = 0.8
SHINGLE = 5
BANDS = 24
ROWS = 4
ALL_PAIRS = 24  # documents of a key that are paired; more are searched together
_CHUNK = 1 << 12  # shingles that are permuted at a time
_LOOKUPS = 1 << 18  # shingles that are looked up at a time
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALTS = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes (XXH3, 64 bits) of the word shingles, A-Z lower-cased; a shorter text is one shingle."""
    words = simhash._WORD.findall((text or "").encode().lower())
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    stops = ends[min(size, len(words)) - 1 :].tolist()
    starts = [0, *(ends[: len(stops) - 1] + 1).tolist()]
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(joined[a:b]) for a, b in zip(starts, stops)), np.uint64, len(stops)))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key per band."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _CHUNK):
        least = np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + _CHUNK]).min(axis=1))
    key = _SALTS.copy()
    for row in least.reshape(BANDS, ROWS).T:
        key = (key ^ (key >> np.uint64(31)) ^ row) * np.uint64(0xBF58476D1CE4E5B9)
    return key ^ (key >> np.uint64(29))


def similar(common, left, right, limit: float):
    """Whether sets of these sizes with so many common members are similar enough; in whole numbers."""
    return 1000 * common >= round(1000 * limit) * (left + right - common)


def _mark(batches, text_at: int, shingle: int):
    for batch in base.slices(batches, text=text_at):
        nodes, keys, prints = [], [], []
        for text in batch.column(text_at).to_pylist():
            found = shingles(text, shingle)
            prints.append(simhash.fingerprint(text or "", shingle)[0])
            nodes.append(xxhash.xxh3_64_intdigest(found.tobytes()))
            keys.append(band_keys(found))
        offsets = pa.array(np.arange(0, BANDS * len(keys) + 1, BANDS, dtype=np.int32))
        values = pa.array(np.concatenate(keys).view(np.int64))
        longs = [pa.array(np.array(c, np.uint64).view(np.int64)) for c in (nodes, prints)]
        columns = [longs[0], pa.ListArray.from_arrays(offsets, values), longs[1]]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "_node", "_keys", "_print"])


def _meet(batches, all_pairs: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b): the pairs of a key, or each of its nodes with null ``b`` where they are many. Rows come sorted by key."""

    def rows(key: int, nodes: np.ndarray):
        if len(nodes) > all_pairs:
            return np.full(len(nodes), key), nodes, np.zeros(len(nodes), np.int64), np.ones(len(nodes), bool)
        a, b = np.triu_indices(len(nodes), 1)
        return np.full(len(a), key), nodes[a], nodes[b], np.zeros(len(a), bool)

    def batch_of(found: list) -> pa.RecordBatch:
        key, a, b, many = map(np.concatenate, zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(b, mask=many)], ["key", "a", "b"])

    open_key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, nodes, found = np.asarray(batch.column(0)), np.asarray(batch.column(1)), []
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            if parts and keys[a] != open_key:
                if len(parts) > 1 or len(parts[0]) > 1:
                    found.append(rows(open_key, np.concatenate(parts)))
                parts = []
            open_key = keys[a]
            parts.append(nodes[a:b])
        if found:
            yield batch_of(found)
    if parts:
        yield batch_of([rows(open_key, np.concatenate(parts))])


def _verify(batches, limit: float, shingle: int) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of rows (a, b, text of a, text of b) that are similar enough."""
    known: dict[int, np.ndarray] = {}

    def sets(node: int, text: str) -> np.ndarray:
        if node not in known:
            if len(known) >= 256:
                known.clear()
            known[node] = shingles(text, shingle)
        return known[node]

    for batch in base.slices(batches, text=2, limit=base.SLICE_BYTES // 2):
        a, b, left, right = (c.to_pylist() for c in batch.columns)
        keep = []
        for m, n, s, t in zip(a, b, left, right):
            x, y = sets(m, s), sets(n, t)
            low, high = sorted((len(x), len(y)))
            keep.append(similar(low, low, high, limit) and similar(len(np.intersect1d(x, y, assume_unique=True)), low, high, limit))
        yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def spanning(sets: list[np.ndarray], limit: float) -> list[tuple[int, int]]:
    """Verified links that connect all that chains of similar pairs connect among ``sets``; at most one per member."""
    sizes = np.array([len(s) for s in sets], np.int64)
    flat, owner, rest = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), sizes), np.ones(len(sets), bool)
    links = []

    def shared(mine: np.ndarray) -> np.ndarray:
        """Members of each set that are in ``mine``; in pieces, so that lookups take no more memory than the sets."""
        common = np.zeros(len(sets), np.int64)
        for at in range(0, len(flat) if len(mine) else 0, _LOOKUPS):
            part = flat[at : at + _LOOKUPS]
            hits = mine[np.minimum(np.searchsorted(mine, part), len(mine) - 1)] == part
            common += np.bincount(owner[at : at + _LOOKUPS][hits], minlength=len(sets))
        return common

    for start in range(len(sets)):
        if not rest[start]:
            continue
        rest[start], queue = False, [start]
        while queue and rest.any():
            here = queue.pop()
            inside = rest[owner]
            if not inside.all():
                flat, owner = flat[inside], owner[inside]
            reached = np.flatnonzero(rest & similar(shared(sets[here]), sizes, sizes[here], limit)).tolist()
            rest[reached] = False
            links.extend((here, r) for r in reached)
            queue.extend(reached)
    return links


def _search(batches, limit: float, shingle: int) -> Iterator[pa.RecordBatch]:
    """Links within each key of rows (key, node, text) sorted by key; one key's shingles are held at a time."""
    open_key, nodes, sets = None, [], []

    def finish() -> pa.RecordBatch:
        found = [sorted((nodes[a], nodes[b])) for a, b in spanning(sets, limit)]
        return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in base.slices(batches, text=2):
        for key, node, text in zip(*(c.to_pylist() for c in batch.columns)):
            if nodes and key != open_key:
                yield finish()
                nodes, sets = [], []
            open_key = key
            nodes.append(node)
            sets.append(shingles(text, shingle))
    if nodes:
        yield finish()


def links(marked: DataFrame, text_col: str, limit: float = SIMILAR, shingle: int = SHINGLE, all_pairs: int = ALL_PAIRS) -> DataFrame:
    """``(a, b)`` nodes of similar documents, enough of them to connect all that are connected."""
    spark = marked.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    keyed = marked.select("_node", "_keys").distinct().select(F.explode("_keys").alias("key"), "_node")
    ordered = keyed.repartition("key").sortWithinPartitions("key", "_node")
    met = stored(ordered.mapInArrow(base.packaged(_meet, all_pairs=all_pairs), "key long, a long, b long"), "met")
    prints = marked.select(F.col("_node").alias("node"), F.col("_print").alias("fp0")).distinct()
    close = stored(simhash.links(prints, simhash.plan_blocks(prints.count())).where("a <> b"), "close")
    pairs = met.where("b is not null").select("a", "b").union(close).distinct()
    many = met.where("b is null").select("key", F.col("a").alias("node"))
    ends = F.explode(F.array("a", "b")).alias("_node")
    nodes = met.select(ends).union(close.select(ends)).where("_node is not null").distinct()
    one = marked.join(lines._joinable(nodes, 16), "_node", "left_semi").groupBy(F.col("_node").alias("node")).agg(F.first(text_col).alias("text"))
    texts = stored(one, "texts")
    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    run = base.packaged(_verify, limit=limit, shingle=shingle)
    paired = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")
    held = many.join(texts, "node").select("key", "node", "text").repartition("key").sortWithinPartitions("key", "node")
    searched = held.mapInArrow(base.packaged(_search, limit=limit, shingle=shingle), "a long, b long")
    return stored(paired.union(searched).distinct(), "verified")


def keep_one(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    similar: float = SIMILAR,
    shingle: int = SHINGLE,
    all_pairs: int = ALL_PAIRS,
) -> DataFrame:
    """One row of ``docs`` per group of near-duplicates: the smallest id, null ids last, then the smallest text hash.

    Documents are linked where the Jaccard similarity of their shingle sets is ``similar`` or more; groups are the connected
    components. Equal sets are one node from the start. Null, empty and blank texts are equal to each other. Columns of ``docs``
    may have any names.
    """
    spark, names = docs.sparkSession, docs.columns
    docs, (id_col, text_col) = base.numbered_columns(docs, id_col, text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType()), T.StructField("_keys", T.ArrayType(T.LongType())), T.StructField("_print", T.LongType())])
    run = base.packaged(_mark, text_at=docs.columns.index(text_col), shingle=shingle)
    path = scratch(spark, "marked")
    docs.mapInArrow(run, schema).write.parquet(path)
    marked = spark.read.schema(schema).parquet(path)
    roots = simhash.components(spark, links(marked, text_col, similar, shingle, all_pairs))
    return simhash.keep_first(marked, roots, id_col, text_col).select(*docs.columns).toDF(*names)

"""Source divergence audit: how the term shares of sources differ from each other and from their language.

Terms of enough documents are found by iceberg refinement of byte prefixes. A prefix that reaches too few documents cannot
begin a term that reaches more, so each level extends only the prefixes that passed the last, until terms are whole.
Documents are tokenised once, into packed slices of sorted terms and postings; the levels and the counts read those.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import base

MIN_DOCS = 30
SMOOTHING = 5
TOP_TERMS = 50
FIRST_LEVEL = 4  # bytes of the shortest prefixes; each level doubles them
SLICE_BYTES = 16 << 20
FILTER_BITS = 28  # at most 2^28 bits (32 MB), whatever the number of prefixes
BLOCK_TERMS = 1024
TILE = 256
_SEGMENT_BITS = 20
_TERM = re.compile(rb"[a-z\x80-\xff]+")

PACKED = "lang string, sources array<string>, source_of binary, terms binary, n_docs binary, doc binary, n binary"


def _packed(batches, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Slices of one language: sorted terms (joined by zero bytes) and the postings (term, document, occurrences)."""
    for batch in base.slices(batches, text=2, limit=slice_bytes):
        langs, sources, texts = (c.to_pylist() for c in batch.columns)
        for lang in sorted(set(langs)):
            rows = [i for i, found in enumerate(langs) if found == lang]
            numbers: defaultdict[bytes, int] = defaultdict()
            numbers.default_factory = numbers.__len__  # a new term gets the next number
            codes, sizes = [], []
            for i in rows:
                words = _TERM.findall(texts[i].encode().lower())
                codes.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                sizes.append(len(words))
            names = list(numbers)
            order = sorted(range(len(names)), key=names.__getitem__)
            place = np.empty(len(names), np.int64)
            place[order] = np.arange(len(names))
            pairs = place[np.concatenate(codes)] * len(rows) + np.repeat(np.arange(len(rows)), sizes)
            pairs, counts = np.unique(pairs, return_counts=True)
            term, doc = np.divmod(pairs, len(rows))
            named = sorted({sources[i] for i in rows})
            source_at = {name: k for k, name in enumerate(named)}
            source_of = [source_at[sources[i]] for i in rows]
            n_docs = np.bincount(term, minlength=len(names))
            packed = [np.asarray(c).astype("<u4").tobytes() for c in (source_of, n_docs, doc, counts)]
            columns = [[lang], [named], [packed[0]], [b"\0".join(names[i] for i in order)], *([p] for p in packed[1:])]
            kinds = [pa.string(), pa.list_(pa.string()), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "sources", "source_of", "terms", "n_docs", "doc", "n"])


class Slice:
    """One packed slice; ``keys`` are its terms with an end mark, in order."""

    def __init__(self, row: dict):
        self.lang, self.sources = row["lang"], row["sources"]
        self.source_of, n_docs, self.doc, self.n = (np.frombuffer(row[c], "<u4").astype(np.int64) for c in ("source_of", "n_docs", "doc", "n"))
        self.keys = [t + b"\0" for t in row["terms"].split(b"\0")] if row["terms"] else []
        self.term = np.repeat(np.arange(len(self.keys)), n_docs)


def _slices(batches) -> Iterator[Slice]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield Slice(batch.slice(at, 1).to_pylist()[0])


class Filter:
    """A bit per hash of (language, prefix). It may pass a prefix that was not added, which costs work but no correctness."""

    def __init__(self, bits: int, segments: dict[int, bytes]):
        size = min(bits, _SEGMENT_BITS)
        empty = bytes(-(-(1 << size) // 8))
        self.bits, self.data = bits, b"".join(segments.get(i, empty) for i in range(1 << (bits - size)))

    def passed(self, lang: str, prefixes: list[bytes]) -> np.ndarray:
        at = _places(lang, prefixes, self.bits)
        return (np.frombuffer(self.data, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def _places(lang: str, prefixes: list[bytes], bits: int) -> np.ndarray:
    seed = xxhash.xxh3_64_intdigest(lang.encode())
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(p, seed) for p in prefixes), np.uint64, len(prefixes))
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _hashed(batches, bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = np.array([_places(lang, [prefix], bits)[0] for lang, prefix in zip(*(c.to_pylist() for c in batch.columns))], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at >> _SEGMENT_BITS), pa.array(at & ((1 << _SEGMENT_BITS) - 1))], ["segment", "bit"])


def _filter(prefixes: DataFrame, n: int) -> Filter:
    """The filter of ``n`` rows ``(lang, prefix)``; segments are set in tasks, so the driver sees its fixed size only."""
    bits = min(FILTER_BITS, max(10, (16 * max(1, n) - 1).bit_length()))

    def segment(table: pa.Table) -> pa.Table:
        bitmap = np.zeros(1 << min(bits, _SEGMENT_BITS), np.uint8)
        bitmap[table.column("bit").to_numpy()] = 1
        packed = np.packbits(bitmap, bitorder="little").tobytes()
        return pa.table([pa.array([table.column("segment")[0].as_py()], pa.int64()), pa.array([packed], pa.binary())], names=["segment", "bits"])

    hashed = prefixes.mapInArrow(base.packaged(_hashed, bits=bits), "segment long, bit long").distinct()
    return Filter(bits, {row[0]: bytes(row[1]) for row in hashed.groupBy("segment").applyInArrow(segment, "segment long, bits binary").collect()})


def _prefixes(batches, before: int, length: int, broadcast) -> Iterator[pa.RecordBatch]:
    """Documents of each slice that hold each prefix of ``length`` bytes, of terms whose last prefix passed."""
    for part in _slices(batches):
        wanted = np.flatnonzero([len(k) > before for k in part.keys])
        if before and len(wanted):
            wanted = wanted[broadcast.value.passed(part.lang, [part.keys[i][:before] for i in wanted.tolist()])]
        if not len(wanted):
            continue
        cut = [part.keys[i][:length] for i in wanted.tolist()]
        first = np.array([True, *(a != b for a, b in zip(cut[1:], cut))])
        number = np.full(len(part.keys), -1)
        number[wanted] = np.cumsum(first) - 1
        held, n_docs = number[part.term] >= 0, len(part.source_of)
        pairs = np.sort(number[part.term[held]] * n_docs + part.doc[held])
        pairs = pairs[np.r_[True, pairs[1:] != pairs[:-1]]]
        counts = np.bincount(pairs // n_docs, minlength=int(first.sum()))
        names = [cut[i] for i in np.flatnonzero(first)]
        columns = [pa.array([part.lang] * len(names), pa.string()), pa.array(names, pa.binary()), pa.array(counts)]
        yield pa.RecordBatch.from_arrays(columns, ["lang", "prefix", "n_docs"])


def frequent_terms(packed: DataFrame, min_docs: int = MIN_DOCS, first_level: int = FIRST_LEVEL) -> DataFrame:
    """``(lang, prefix, n_docs)`` of whole terms (with an end mark) in at least ``min_docs`` documents of a language.

    One job a level: prefixes of 4 bytes, then 8, 16, ...; a term is whole at the level that reaches its end mark. The
    number of levels is the logarithm of the longest prefix that enough documents share.
    """
    context = packed.sparkSession.sparkContext
    before, length, broadcast, levels = 0, first_level, None, []
    while True:
        run = base.packaged(_prefixes, before=before, length=length, broadcast=broadcast)
        counted = packed.mapInArrow(run, "lang string, prefix binary, n_docs long").groupBy("lang", "prefix").agg(F.sum("n_docs").alias("n_docs"))
        level = base.stored(counted.where(F.col("n_docs") >= min_docs), "prefixes")
        whole = F.substring("prefix", -1, 1) == F.lit(b"\0")
        levels.append(level.where(whole))
        rest = level.where(~whole).select("lang", "prefix")
        n = rest.count()
        if broadcast is not None:
            broadcast.unpersist()
        if not n:
            break
        broadcast = context.broadcast(_filter(rest, n))
        before, length = length, 2 * length
    found = levels[0]
    for level in levels[1:]:
        found = found.union(level)
    return found


def _cells(batches, broadcast, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Occurrences by source of the terms that may be kept, added up over the slices of a task until ``limit`` cells are held."""
    held: dict[str, tuple] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, (terms, sources, keys, counts) in held.items():
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, at, np.concatenate(counts))
            term, source = key >> 32, key & 0xFFFFFFFF
            names = [pa.array([lang] * len(key), pa.string()), pa.array(list(sources), pa.string()).take(pa.array(source))]
            yield pa.RecordBatch.from_arrays([*names, pa.array(list(terms), pa.binary()).take(pa.array(term)), pa.array(n)], ["lang", "source", "prefix", "n"])
        held.clear()

    for part in _slices(batches):
        passed = broadcast.value.passed(part.lang, part.keys) if part.keys else np.zeros(0, bool)
        if not passed.any():
            continue
        terms, sources, keys, counts = held.setdefault(part.lang, ({}, {}, [], []))
        term_at = np.full(len(part.keys), -1)
        term_at[passed] = [terms.setdefault(part.keys[i], len(terms)) for i in np.flatnonzero(passed).tolist()]
        source_at = np.array([sources.setdefault(s, len(sources)) for s in part.sources])
        kept = passed[part.term]
        key, at = np.unique(term_at[part.term[kept]] << 32 | source_at[part.source_of[part.doc[kept]]], return_inverse=True)
        n = np.zeros(len(key), np.int64)
        np.add.at(n, at, part.n[kept])
        keys.append(key)
        counts.append(n)
        size += len(key)
        if size >= limit:
            yield from flush()
            size = 0
    yield from flush()


def _div(left: Column, right: Column) -> Column:
    return F.call_function("div", left, right)


def _share(count: Column, total: Column) -> Column:
    """``1 + floor(10^9 * (count + 5) / total)`` in whole numbers; three long divisions, so totals may reach 9.2e15."""
    out, rest = F.lit(1).cast("long"), count + SMOOTHING
    for scale in (1_000_000, 1_000, 1):
        out = out + _div(rest * 1000, total) * scale
        rest = (rest * 1000) % total
    return out


def _distances(table: pa.Table, tile_size: int) -> pa.Table:
    """Summed share differences of the pairs of groups in one block of terms, and how many of its terms were seen.

    Rows with a null term are the groups of the two tiles, with the share of a term that they lack.
    """
    lang, low, high = (table.column(c)[0].as_py() for c in ("lang", "low", "high"))
    number, share = (table.column(c).to_numpy() for c in ("number", "share"))
    term = table.column("term").combine_chunks().dictionary_encode()
    codes = np.asarray(term.indices.fill_null(-1))
    group = codes < 0
    order = np.argsort(number[group])
    numbers, base_share = number[group][order], share[group][order]
    n_terms = len(term.dictionary)
    shares = np.repeat(base_share[:, None], n_terms, axis=1)
    shares[np.searchsorted(numbers, number[~group]), codes[~group]] = share[~group]
    tile = numbers // tile_size
    right = np.flatnonzero(tile == high)
    a, b, sums = [], [], []
    for i in np.flatnonzero(tile == low).tolist():
        others = right[right > i] if low == high else right
        a.append(np.full(len(others), numbers[i]))
        b.append(numbers[others])
        sums.append(np.abs(shares[others] - shares[i]).sum(axis=1))
    a, b, sums = (np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64) for c in (a, b, sums))
    return pa.table([pa.array([lang] * len(a), pa.string()), a, b, sums, np.full(len(a), n_terms)], names=["lang", "a", "b", "part", "seen"])


def _pairs(cells: DataFrame, groups: DataFrame, tile_size: int) -> DataFrame:
    """``(lang, source, item, value)`` for each group and each other source of its language.

    Groups of a language meet in tiles of ``tile_size`` and in blocks of terms, so a task holds two tiles of one
    block however large the language is. Terms that both groups lack differ by their base shares alone.
    """
    block = F.pmod(F.xxhash64("prefix"), F.col("n_blocks"))
    tiles = F.sequence(F.lit(0).cast("long"), F.col("n_tiles") - 1)
    tile = _div(F.col("number"), F.lit(tile_size))
    spread = [F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "number"]
    numbered = groups.withColumn("tile", tile).withColumn("other", F.explode(tiles))
    filled = cells.join(groups.select("lang", "source", "number", "n_blocks", "n_tiles"), ["lang", "source"])
    filled = filled.withColumn("block", block).withColumn("tile", tile).withColumn("other", F.explode(tiles))
    present = filled.select("lang", "block", *spread, F.col("prefix").alias("term"), "share")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1))
    bases = numbered.withColumn("block", blocks).select("lang", "block", *spread, F.lit(None).cast("binary").alias("term"), F.col("base").alias("share"))
    schema = "lang string, a long, b long, part long, seen long"

    def distances(table: pa.Table) -> pa.Table:
        return _distances(table, tile_size)

    parts = present.union(bases).groupBy("lang", "block", "low", "high").applyInArrow(distances, schema)
    summed = parts.groupBy("lang", "a", "b").agg(F.sum("part").alias("part"), F.sum("seen").alias("seen"))
    named = groups.select("lang", "number", "source", "base", "n_terms")
    left, right = (named.select("lang", F.col("number").alias(k), F.col("source").alias(f"source_{k}"), F.col("base").alias(f"base_{k}"), *extra) for k, extra in (("a", ["n_terms"]), ("b", [])))
    rest = (F.col("n_terms") - F.col("seen")) * F.abs(F.col("base_a") - F.col("base_b"))
    valued = summed.join(left, ["lang", "a"]).join(right, ["lang", "b"]).withColumn("value", F.col("part") + rest)
    both = F.array(F.struct(F.col("source_a").alias("source"), F.col("source_b").alias("item")), F.struct(F.col("source_b").alias("source"), F.col("source_a").alias("item")))
    return valued.select("lang", F.explode(both).alias("p"), "value").select("lang", "p.source", "p.item", "value")


def audit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_docs: int = MIN_DOCS,
    top: int = TOP_TERMS,
    first_level: int = FIRST_LEVEL,
    slice_bytes: int = SLICE_BYTES,
    block_terms: int = BLOCK_TERMS,
    tile_size: int = TILE,
) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how each (language, source) group differs from others and its language.

    A language keeps the terms (letters and everything beyond ASCII, A-Z lower-cased) in at least ``min_docs`` of its rows. A
    kept term has the share ``1 + floor(10^9 * (count + 5) / (N + 5 * V))`` in each group and in the language, with N
    occurrences of the V kept terms there. Part ``pair`` gives the summed share difference to each other source of
    the language, all of them: the result grows with the square of a language's sources. Part ``term`` gives the ``top``
    kept terms that the group holds and that have a larger share in it than in the language, with the difference. Ranks
    go by value, then by item in byte order.

    Prefix counts are combined per slice before they shuffle, so a hot language or source costs each slice one row per
    prefix. Levels prune through a bit filter of fixed size; final counts join on the exact terms.

    Null text, language and source are empty strings; each row is a document, so repeated rows count again; groups
    without terms take part with the base share; without kept terms all pair values are 0 and no term row comes; an empty
    table gives no rows; other columns are ignored.
    """
    rows = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    context = docs.sparkSession.sparkContext
    packed = base.stored(rows.mapInArrow(base.packaged(_packed, slice_bytes=slice_bytes), PACKED), "packed")
    kept = base.stored(frequent_terms(packed, min_docs, first_level), "kept")
    broadcast = context.broadcast(_filter(kept.select("lang", "prefix"), kept.count()))
    found = packed.mapInArrow(base.packaged(_cells, broadcast=broadcast), "lang string, source string, prefix binary, n long")
    counted = found.groupBy("lang", "source", "prefix").agg(F.sum("n").alias("n"))
    cells = base.stored(counted.join(kept.select("lang", "prefix"), ["lang", "prefix"], "left_semi"), "cells")
    broadcast.unpersist()

    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = groups.na.fill(0, ["size", "n_terms"]).withColumn("total", F.col("size") + SMOOTHING * F.col("n_terms"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = groups.select("lang", "source", "size", "n_terms", "total", number.cast("long").alias("number"))
    shape = groups.groupBy("lang").agg(F.count(F.lit(1)).alias("n_sources"), F.sum("size").alias("lang_size"))
    groups = base.stored(
        groups.join(shape, "lang").select(
            "lang",
            "source",
            "number",
            "n_terms",
            "total",
            (F.col("lang_size") + SMOOTHING * F.col("n_terms")).alias("lang_total"),
            F.when(F.col("n_terms") > 0, _share(F.lit(0).cast("long"), F.col("total"))).otherwise(0).alias("base"),
            _div(F.col("n_terms") + (block_terms - 1), F.lit(block_terms)).alias("n_blocks"),
            _div(F.col("n_sources") + (tile_size - 1), F.lit(tile_size)).alias("n_tiles"),
        ),
        "groups",
    )
    groups = groups.withColumn("n_blocks", F.greatest("n_blocks", F.lit(1).cast("long")))
    shared = cells.join(groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    shared = shared.select("lang", "source", "prefix", "n", _share(F.col("n"), F.col("total")).alias("share"), "lang_total")
    pairs = _pairs(shared.select("lang", "source", "prefix", "share"), groups, tile_size)

    whole = cells.groupBy("lang", "prefix").agg(F.sum("n").alias("lang_n"))
    excess = F.col("share") - _share(F.col("lang_n"), F.col("lang_total"))
    text = F.expr("substring(prefix, 1, octet_length(prefix) - 1)").cast("string")
    above = shared.join(whole, ["lang", "prefix"]).select("lang", "source", text.alias("item"), excess.alias("value")).where("value > 0")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")

    def ranked(df: DataFrame, part: str) -> DataFrame:
        return df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))

    return ranked(pairs, "pair").union(ranked(above, "term").where(F.col("rank") <= top))

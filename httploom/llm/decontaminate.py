"""Benchmark decontamination with suffix arrays over the training words.

Each slice of the corpus is a shard. Its suffix array is sorted by words to the depth of a window; every test suffix
is found in it by binary search, and neighbouring finds join to the longest verbatim matches with their places.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

WINDOW = 10
BLOCK_BYTES = 4 << 20
SEED = 3  # first words that a suffix must share with some test suffix to enter the array
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

MATCH = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("item_start", T.IntegerType()),
        T.StructField("doc_start", T.IntegerType()),
        T.StructField("n_words", T.IntegerType()),
    ]
)
_MATCH_ARROW = pa.list_(pa.struct([("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32()), ("n_words", pa.int32())]))


def words(text: str | None) -> list[bytes]:
    """Words of digits, letters and everything beyond ASCII, A-Z lower-cased; null has none."""
    return [] if text is None else _WORD.findall(text.encode().lower())


class Tests:
    """Windows of a block of test items, ready for the search; ``ids`` number the block's own words from 1."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = [name for name, _ in items]
        self.ids: dict[bytes, int] = {}
        self.window = window
        grouped: dict[int, list[tuple[list[int], int, int]]] = {}
        for number, (_, text) in enumerate(items):
            coded = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text)]
            length = min(window, len(coded))
            if length:
                grouped.setdefault(length, []).extend((coded[k : k + length], number, k) for k in range(len(coded) - length + 1))
        # Distinct test suffixes by length: the word ids of the window, and a slice of the (item, place) pairs it stands at.
        self.suffixes = {}
        for length, all_ in grouped.items():
            windows = np.array([w for w, _, _ in all_], np.uint32)
            distinct, which = np.unique(windows, axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            ends = np.cumsum(np.bincount(which.ravel()))
            self.suffixes[length] = (distinct, ends, np.array([n for _, n, _ in all_])[order], np.array([k for _, _, k in all_])[order])
        self.seeds = {
            size: np.unique(np.concatenate([_seed_keys(w[0][:, :size]) for length, w in self.suffixes.items() if min(length, SEED) == size]))
            for size in {min(length, SEED) for length in self.suffixes}
        }


def _seed_keys(columns: np.ndarray) -> np.ndarray:
    """Mixed word ids; equal words give equal keys, and a chance collision only lets one more suffix in."""
    key = np.zeros(len(columns), np.uint64)
    for column in columns.T:
        key = (key + column.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def _sort_keys(columns: np.ndarray, depth: int, pad: int) -> np.ndarray:
    """Word id rows as fixed-width byte strings that sort like the rows; short rows are padded."""
    wide = np.full((len(columns), depth), pad, ">u4")
    wide[:, : columns.shape[1]] = columns
    return np.ascontiguousarray(wide).view(f"S{4 * depth}").ravel()


def search(ids: np.ndarray, tests: Tests) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """By window length: places in the shard's word ids, and the number of the distinct test suffix that stands there.

    0 stands for words that no test has and for the gaps between documents. Suffixes whose first words begin no
    test suffix cannot match and are left out of the array before it is sorted.
    """
    found = []
    size = len(ids)
    padded = np.concatenate([ids, np.zeros(tests.window, ids.dtype)])
    start = np.zeros(size, bool)
    for length, seeds in tests.seeds.items():
        can = ids != 0
        for k in range(1, length):
            can &= padded[k : k + size] != 0
        at = np.flatnonzero(can)
        keys = _seed_keys(np.stack([padded[at + k] for k in range(length)], axis=1)) if len(at) else np.zeros(0, np.uint64)
        near = np.minimum(np.searchsorted(seeds, keys), len(seeds) - 1)
        start[at[seeds[near] == keys]] = True
    places = np.flatnonzero(start)
    if not len(places):
        return found
    depth = tests.window
    array_keys = _sort_keys(np.stack([padded[places + k] for k in range(depth)], axis=1), depth, 0)
    order = np.argsort(array_keys, kind="stable")
    array_keys, places = array_keys[order], places[order]
    for length, (windows, *_) in tests.suffixes.items():
        low = np.searchsorted(array_keys, _sort_keys(windows, depth, 0), side="left")
        high = np.searchsorted(array_keys, _sort_keys(windows, depth, 0xFFFFFFFF), side="right")
        hits = high - low
        if hits.any():
            window = np.repeat(np.arange(len(windows)), hits)
            within = np.arange(len(window)) - np.repeat(np.cumsum(hits) - hits, hits)
            found.append((length, places[low[window] + within], window))
    return found


def _spread(window: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window its slice below ``ends``: the row of ``window`` and the place in the slice, one after the other."""
    counts = np.diff(np.r_[0, ends])[window]
    row = np.repeat(np.arange(len(window)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + (ends[window] - counts)[row]


def longest(place: np.ndarray, item: np.ndarray, item_place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join finds that continue each other word by word to maximal matches."""
    diagonal = place - item_place
    order = np.lexsort((place, diagonal, item))
    place, item, item_place, length, diagonal = (c[order] for c in (place, item, item_place, length, diagonal))
    first = np.r_[True, (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (place[1:] != place[:-1] + 1)]
    heads = np.flatnonzero(first)
    runs = np.diff(np.r_[heads, len(place)])
    return place[heads], item[heads], item_place[heads], length[heads] + runs - 1


def _shard(texts: list[str], blocks: list, with_matches: bool) -> tuple[list[int], list[int], list[list[str]], list[list[dict]]]:
    split = [words(text) for text in texts]
    counts = [len(w) for w in split]
    starts = np.cumsum([0] + [n + 1 for n in counts])  # one gap after each document
    edge = np.zeros(int(starts[-1]) + 1, np.int64)
    items: list[set[str]] = [set() for _ in texts]
    matches: list[list[dict]] = [[] for _ in texts]
    for block in blocks:
        tests = _unpickled(block)
        ids = np.zeros(int(starts[-1]), np.int64)
        known = tests.ids.get
        for start, found in zip(starts.tolist(), split):
            ids[start : start + len(found)] = np.fromiter((known(w, 0) for w in found), np.int64, len(found))
        finds = search(ids, tests)
        spelled = []
        for length, place, window in finds:
            np.add.at(edge, place, 1)
            np.add.at(edge, place + length, -1)
            _, ends, owners, item_places = tests.suffixes[length]
            doc = np.searchsorted(starts, place, side="right") - 1
            held = np.unique(doc * len(ends) + window)  # a window of a document once, however often it stands there
            row, at = _spread(held % len(ends), ends)
            pairs = np.unique((held // len(ends))[row] * len(tests.names) + owners[at])
            for d, i in zip(*(v.tolist() for v in np.divmod(pairs, len(tests.names)))):
                items[d].add(tests.names[i])
            if with_matches:
                row, at = _spread(window, ends)
                spelled.append((place[row], owners[at], item_places[at], np.full(len(row), length)))
        if spelled:
            place, item, item_place, length = longest(*(np.concatenate(c) for c in zip(*spelled)))
            doc = np.searchsorted(starts, place, side="right") - 1
            for d, i, k, p, n in zip(doc.tolist(), item.tolist(), item_place.tolist(), (place - starts[doc]).tolist(), length.tolist()):
                matches[d].append({"item_id": tests.names[i], "item_start": k, "doc_start": p, "n_words": n})
    covered = np.r_[0, np.cumsum(np.cumsum(edge) > 0)]
    hits = covered[starts[1:] - 1] - covered[starts[:-1]]
    return counts, hits.tolist(), [sorted(i) for i in items], matches


_blocks: dict[str, Tests] = {}


def _unpickled(block) -> Tests:
    """The block behind a broadcast variable; a worker keeps one at a time."""
    if block.id not in _blocks:
        _blocks.clear()
        _blocks[block.id] = pickle.loads(block.value)
    return _blocks[block.id]


class _Block:
    """A broadcast of one pickled block, with an id for workers to remember it by."""

    def __init__(self, broadcast):
        self.broadcast, self.id = broadcast, uuid.uuid4().hex

    @property
    def value(self) -> bytes:
        return self.broadcast.value


def _match(batches, blocks: list, with_matches: bool, slice_bytes: int, text_at: int, kept: list[int], into: str) -> Iterator[pa.RecordBatch]:
    for batch in base.slices(batches, text=text_at, limit=slice_bytes):
        counts, hits, items, matches = _shard(batch.column(text_at).to_pylist(), blocks, with_matches)
        columns = [pa.array(counts, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string()))]
        names = ["n_words", "n_hit", "items"]
        if with_matches:
            columns.append(pa.array(matches, _MATCH_ARROW))
            names.append("matches")
        found = pa.StructArray.from_arrays(columns, names)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], [*(batch.schema.names[c] for c in kept), into])


def _item_blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[bytes]:
    """Pickled blocks of items, each of about ``block_bytes`` of text; the driver holds one block's items at a time."""
    block, size = [], 0
    for name, text in items.toLocalIterator():
        block.append((name or "", text))
        size += len(text.encode())
        if size >= block_bytes:
            yield pickle.dumps(Tests(block, window))
            block, size = [], 0
    if block:
        yield pickle.dumps(Tests(block, window))


def _found_type(with_matches: bool) -> T.StructType:
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]
    return T.StructType(fields + [T.StructField("matches", T.ArrayType(MATCH))] * with_matches)


def marked(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    with_matches: bool = True,
    columns: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
    slice_bytes: int = base.SLICE_BYTES,
    into: str = "_found",
) -> DataFrame:
    """Rows of ``docs`` (its ``columns``, all by default) with a struct ``into``: ``n_words, n_hit, items[, matches]``.

    A window is ``window`` consecutive words of an item; an item of fewer words is one window. ``n_hit`` counts the
    document's words inside windows, ``items`` lists the ids (as strings, sorted) of the items with a window in it,
    ``matches`` the maximal verbatim matches with their places in words.

    The benchmark travels in blocks of ``block_bytes`` of text, one broadcast variable each, searched one after the
    other; a benchmark of any size gives the same result. Documents are not moved. Words are matched exactly (each
    block numbers its own words; others are 0).

    Null text has no words; null ids and repeated rows stay; items with a null id have the empty id, items without
    words never occur; an empty benchmark hits nothing; an empty table gives no rows; other columns are passed on, one
    named ``into`` is replaced.
    """
    docs = docs.drop(into)
    columns = docs.columns if columns is None else columns
    items = benchmark.select(F.col(item_id_col).cast("string").alias("id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    context = docs.sparkSession.sparkContext
    blocks = [_Block(context.broadcast(block)) for block in _item_blocks(items, window, block_bytes)]
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(into, _found_type(with_matches))])
    kept = [docs.columns.index(c) for c in columns]
    run = base.packaged(
        _match, blocks=blocks, with_matches=with_matches, slice_bytes=slice_bytes, text_at=docs.columns.index(text_col), kept=kept, into=into
    )
    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, n_words, n_hit, items[, matches])`` per document row; see ``marked`` for what they mean."""
    rows = docs.select(id_col, text_col)
    (into,) = base.free_names(rows, "_found")
    return marked(rows, benchmark, text_col, columns=[id_col], into=into, **options).select(id_col, f"{into}.*")

"""Ranked lexical search over document FP-trees.

Documents keep only the terms that some query asks for, in order of falling document frequency, so documents with the
same frequent terms share paths of a trie. Every node knows the largest frequency of each term and the smallest length
measure below it, which bounds the score of any document there. Each query walks the trie depth first, best child first,
and leaves out nodes that cannot reach its current top.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

TOP = 50
BLOCK_BYTES = 4 << 20  # query text that is searched at a time
SLICE_BYTES = 8 << 20
TREE_TERMS = 1 << 22  # (document, term) entries of one tree
LEAF_DOCS = 64  # documents of a node that are scored at once
NODE_BYTES = 64 << 20  # of term maxima in one tree
_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")


def terms(text: str | None) -> list[bytes]:
    """Digits, letters and everything beyond ASCII, A-Z lower-cased; null has none."""
    return [] if text is None else _TERM.findall(text.encode().lower())


class Queries:
    """The queries of one block: a number for each of their terms, and the distinct term numbers of each query."""

    def __init__(self, texts: list[str | None]):
        self.numbers: dict[bytes, int] = {}
        self.wanted = [np.unique(np.array([self.numbers.setdefault(w, len(self.numbers)) for w in terms(t)], np.int64)) for t in texts]


class Weights:
    """Corpus statistics of a block: each term's weight and place in the frequency order, document count and length."""

    def __init__(self, queries: Queries, df: dict[int, int], n_docs: int, n_terms: int):
        size = len(queries.numbers)
        counts = np.zeros(size, np.int64)
        counts[list(df)] = list(df.values())
        order = np.lexsort((np.arange(size), -counts))
        self.place = np.empty(size, np.int64)
        self.place[order] = np.arange(size)
        self.weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(c) + 1))) for c in counts[order]], np.int64)
        self.n_docs, self.n_terms = n_docs, n_terms
        self.wanted = [np.sort(self.place[w]) for w in queries.wanted]

    def measures(self, lengths: list[int]) -> np.ndarray:
        """m of each document."""
        return np.array([50 + (50 * n * self.n_docs) // self.n_terms for n in lengths], np.int64)


def _vectors(batches, queries, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Length, and the numbers and frequencies of the queries' terms, of each document."""
    numbers = queries.value.numbers
    size = max(1, len(numbers))
    for batch in base.slices(batches, limit=slice_bytes):
        found, lengths = [], []
        for at, text in enumerate(batch.column(1).to_pylist()):
            words = terms(text)
            codes = np.fromiter(map(numbers.get, words, repeat(-1)), np.int64, len(words))
            found.append(codes[codes >= 0] + at * size)
            lengths.append(len(words))
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        doc, term = np.divmod(keys, size)
        offsets = pa.array(np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v.astype(np.int32))) for v in (term, counts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["id", "n", "terms", "tfs"])


def _frequencies(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        numbers, counts = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int64)), pa.array(counts)], ["term", "df"])


def scores(weights: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Contributions of terms; rising in tf, falling in m, so maxima of tf and minima of m bound them from above."""
    return weights * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


class Tree:
    """An FP-tree over documents given by their entries (``place`` of the term, ``tf``), sorted by document, then place.

    Documents in order of their place sequences lie so that each trie node is a range of them. Nodes of few documents are
    leaves; small neighbouring subtrees of a node share one leaf. ``children``, ``peak`` (largest tf by place)
    and ``floor`` (smallest m) belong to nodes, root first.
    """

    def __init__(self, starts: np.ndarray, place: np.ndarray, tf: np.ndarray, m: np.ndarray, n_places: int):
        n = len(m)
        keys = place.astype(">u4").tobytes()
        cuts = (4 * starts).tolist()
        self.order = np.array(sorted(range(n), key=lambda d: keys[cuts[d] : cuts[d + 1]]), np.int64)
        sizes = np.diff(starts)[self.order]
        self.starts = np.r_[0, np.cumsum(sizes)]
        entry = np.repeat(starts[:-1][self.order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.place, self.tf, self.m = place[entry], tf[entry], m[self.order]
        self.doc = np.repeat(np.arange(n), sizes)
        leaf_docs = max(LEAF_DOCS, -(-40 * n * n_places // NODE_BYTES))
        self.low, self.high, self.children = [0], [n], [[]]
        waiting = [(0, 0)]
        while waiting:
            node, depth = waiting.pop()
            low, high = self.low[node], self.high[node]
            edge = np.zeros(high - low, bool)
            while high - low > leaf_docs and (sizes[low:high] > depth).any():
                long = sizes[low:high] > depth
                step = np.full(high - low, -1, np.int64)
                step[long] = self.place[self.starts[low:high][long] + depth]
                depth += 1
                edge[1:] |= step[1:] != step[:-1]
                parts = np.r_[0, np.flatnonzero(edge), high - low]
                if high - low - np.diff(parts).max() < leaf_docs // 2:
                    continue  # nearly all still share one path
                cuts = [0]
                for start, stop in zip(parts[1:-1].tolist(), parts[2:].tolist()):
                    if stop - cuts[-1] > leaf_docs:
                        cuts.append(start)
                for start, stop in zip(cuts, [*cuts[1:], high - low]):
                    self.children[node].append(len(self.low))
                    waiting.append((len(self.low), depth))
                    self.low.append(low + start)
                    self.high.append(low + stop)
                    self.children.append([])
                break
        n_nodes = len(self.low)
        self.peak, self.floor = np.zeros((n_nodes, n_places), np.int32), np.full(n_nodes, np.iinfo(np.int64).max)
        for node in range(n_nodes - 1, -1, -1):  # children come after their parent
            below = self.children[node]
            if below:
                self.peak[node], self.floor[node] = self.peak[below].max(axis=0), self.floor[below].min()
            else:
                a, b = self.starts[self.low[node]], self.starts[self.high[node]]
                np.maximum.at(self.peak[node], self.place[a:b], self.tf[a:b])
                self.floor[node] = self.m[self.low[node] : self.high[node]].min()

    def search(self, wanted: np.ndarray, weights: np.ndarray, tie: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``top`` documents above score 0 for the term places ``wanted``, and their scores; ties by ``tie``."""
        weight = weights[wanted]
        bounds = scores(weight, self.peak[:, wanted].astype(np.int64), self.floor[:, None]).sum(axis=1)
        worth = np.zeros(self.peak.shape[1], np.int64)
        worth[wanted] = weight
        best, best_docs, least = np.zeros(0, np.int64), np.zeros(0, np.int64), 1
        waiting = [0]
        while waiting:
            node = waiting.pop()
            if bounds[node] < least:
                continue
            if self.children[node]:
                waiting.extend(sorted(self.children[node], key=bounds.__getitem__))
                continue
            low, high = self.low[node], self.high[node]
            a, b = self.starts[low], self.starts[high]
            value = worth[self.place[a:b]]
            held = np.flatnonzero(value) + a
            if not len(held):
                continue
            total, doc = np.zeros(high - low, np.int64), self.doc[held]
            np.add.at(total, doc - low, scores(value[held - a], self.tf[held], self.m[doc]))
            reached = np.flatnonzero(total >= least)
            best, best_docs = np.r_[best, total[reached]], np.r_[best_docs, self.order[low + reached]]
            if len(best) > top:
                keep = np.lexsort((tie[best_docs], -best))[:top]
                best, best_docs = best[keep], best_docs[keep]
            if len(best) == top:
                least = max(1, int(best.min()))
        return best_docs, best


def _ties(ids: pa.Array) -> np.ndarray:
    """Place of each id in ascending order, nulls last."""
    values = ids.to_pylist()
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, 0 if values[i] is None else values[i]))
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values))
    return out


def _search(batches, broadcast, top: int, tree_terms: int) -> Iterator[pa.RecordBatch]:
    """The best documents of each tree for each query; a tree takes rows until it has ``tree_terms`` entries."""
    weights: Weights = broadcast.value

    def best(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids = table.column("id").combine_chunks()
        lists = table.column("terms").combine_chunks()
        starts = lists.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        place = weights.place[lists.flatten().to_numpy()]
        tf = table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
        order = np.lexsort((place, np.repeat(np.arange(len(ids)), np.diff(starts))))
        tree = Tree(starts, place[order], tf[order], weights.measures(table.column("n").to_pylist()), len(weights.weight))
        tie = _ties(ids)
        queries, docs, totals = [], [], []
        for number, wanted in enumerate(weights.wanted):
            if len(wanted):
                found, value = tree.search(wanted, weights.weight, tie, top)
                queries.append(np.full(len(found), number))
                docs.append(found)
                totals.append(value)
        none = np.zeros(0, np.int64)
        queries, docs, totals = (np.concatenate([none, *c]) for c in (queries, docs, totals))
        return pa.RecordBatch.from_arrays([pa.array(queries.astype(np.int32)), ids.take(pa.array(docs)), pa.array(totals)], ["query", "id", "score"])

    parts, size = [], 0
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column(2).offsets.to_numpy().astype(np.int64)))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + tree_terms - size, side="right")))
            parts.append(batch.slice(at, stop - at))
            size += int(ends[stop - 1]) - done
            at = stop
            if size >= tree_terms or at < batch.num_rows:
                yield best(parts)
                parts, size = [], 0
    if parts:
        yield best(parts)


def _block(rows: DataFrame, queries: list, top: int, slice_bytes: int, tree_terms: int) -> DataFrame:
    """``(query, id, score)`` of the ``top`` documents of each tree for one block of queries."""
    context = rows.sparkSession.sparkContext
    block = Queries([q["text"] for q in queries])
    shared = context.broadcast(block)
    id_type = rows.schema["id"].dataType.simpleString()
    run = base.packaged(_vectors, queries=shared, slice_bytes=slice_bytes)
    vectors = base.stored(rows.mapInArrow(run, f"id {id_type}, n long, terms array<int>, tfs array<int>"), "vectors")
    shared.unpersist()
    n_docs, n_terms = vectors.where("n > 0").agg(F.count(F.lit(1)), F.sum("n")).first()
    counted = vectors.select("terms").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weights = context.broadcast(Weights(block, {r["term"]: r["df"] for r in counted.collect()}, n_docs, n_terms or 1))
    held = vectors.where(F.size("terms") > 0)
    found = held.mapInArrow(base.packaged(_search, broadcast=weights, top=top, tree_terms=tree_terms), f"query int, id {id_type}, score long")
    return base.stored(found, "found")


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    block_bytes: int = BLOCK_BYTES,
    slice_bytes: int = SLICE_BYTES,
    tree_terms: int = TREE_TERMS,
) -> DataFrame:
    """``(item_id, rank, id, score)``: the ``top`` documents of each item by summed term scores, ties by ascending id.

    N documents have a term, L is their number of terms with repeats, n that of one document. A term of df documents weighs
    ``w = floor(1000 * ln((2N + 2) / (2 df + 1)))``; a document's measure is ``m = 50 + (50 n N) div L``. The score sums
    ``w * ((10^9 tf) div (1000 tf + 20 m))`` over the item's distinct terms; only scores above 0 are ranked.

    Items are searched in blocks of about ``block_bytes`` of text, one after the other, so the queries and statistics
    that travel to the tasks are bounded; every block meets all documents. Documents shrink once to the block's terms and do
    not move; each tree gives at most ``top`` rows per item to the shuffle, where Spark's group limit cuts them again.

    Null text has no terms; null ids come last among ties; repeated rows are ranked each; items without a known term
    have no rows; repeated items have a ranking each; no documents or no items give no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
    n_blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)))
    by_block = Window.partitionBy("block").orderBy("item_id", "text")
    numbered = base.stored(numbered.withColumn("query", F.row_number().over(by_block) - 1), "items")
    id_field = T.StructField("id", rows.schema["id"].dataType)
    found = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("block", T.LongType()), T.StructField("query", T.IntegerType()), id_field, T.StructField("score", T.LongType())]))
    for block in range(n_blocks):
        queries = numbered.where(F.col("block") == block).orderBy("query").collect()  # bounded by block_bytes
        if queries:
            best = _block(rows, queries, top, slice_bytes, tree_terms).withColumn("block", F.lit(block).cast("long"))
            found = found.union(best.select("block", "query", "id", "score"))
    order = Window.partitionBy("block", "query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    named = ranked.join(numbered.select("block", "query", "item_id"), ["block", "query"])
    return named.select(F.col("item_id").alias(item_id_col), "rank", F.col("id").alias(id_col), "score")

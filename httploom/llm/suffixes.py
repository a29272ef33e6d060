"""Suffix-array dedup: removal of byte strings that also start in an earlier document.

Every 50-byte window of a document has an anchor, its smallest hashed 24-byte string. Neighbouring windows with one
anchor form a span; equal windows lie in spans of equal anchors, whatever document they come from. Spans are compared
by hash first. Only first occurrences whose anchor has several different spans go on to suffix arrays, one per bucket
of anchors, built by two-stage sorting; runs of common prefixes give the earliest document of each window.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

WINDOW = 50
ANCHOR = 24
CHUNK_BYTES = 8 << 20
_SLICE = 1 << 21  # windows hashed at a time
_POSITION_BITS = 22
_HASH_BYTES, _SPAN_BYTES, _ID_BYTES = 6, 5, 8
_PAD = 80
_M1, _M2, _M3 = (np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _loads(data: np.ndarray) -> np.ndarray:
    """The little-endian 8-byte word at each position; ``data`` has padding behind it."""
    return np.lib.stride_tricks.as_strided(data, shape=(len(data) - 7, 8), strides=(1, 1)).copy().view("<u8").ravel()


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :])


def spans_of(data: np.ndarray, size: int, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last window, anchor hash and content hash of each span of windows with one anchor.

    ``data`` holds ``size`` bytes of concatenated documents, which end at ``ends``, and ``_PAD`` bytes of padding. The
    anchor of a window is the leftmost of its smallest hashes, so it depends on the window alone. Windows are taken
    ``_SLICE`` at a time, which may cut a span in two.
    """
    width = WINDOW - ANCHOR + 1
    found = []
    for start in range(0, max(0, size - WINDOW + 1), _SLICE):
        stop = min(size - WINDOW + 1, start + _SLICE)
        word = _loads(data[start : stop + WINDOW + _PAD - 1])
        n = stop - start + width - 1
        full = _mix(word[:n] * _M1 + (word[8 : 8 + n] ^ (word[8 : 8 + n] >> np.uint64(31))) * _M2 + word[16 : 16 + n] * _M3)
        place = np.arange(n, dtype=np.uint64)
        low = np.uint64((1 << _POSITION_BITS) - 1)
        anchor = (_sliding_min((full & ~low) | place, width) & low).astype(np.int64)
        at = np.arange(start, stop)
        inside = np.ones(stop - start, bool)
        for end in ends[np.searchsorted(ends, start, side="right") : np.searchsorted(ends, stop + WINDOW, side="left") + 1].tolist():
            inside[max(0, end - WINDOW + 1 - start) : max(0, end - start)] = False
        at, anchor = at[inside], anchor[inside]
        if not len(at):
            continue
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]
        head = np.flatnonzero(new)
        first, last = at[head], at[np.r_[head[1:] - 1, len(at) - 1]]
        a, b = first - start, last - start + WINDOW
        content = (b - a).astype(np.uint64) * _M3
        for offset in (0, 8, 16, 24, 32, 40):
            content = _mix((content + word[a + offset]) * _M1)
        for offset in (8, 16, 24, 32):
            content = _mix((content + word[b - offset]) * _M2)
        found.append((first, last, _mix(full[anchor[head]] * _M2), content))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*found))


@dataclass
class Chunk:
    """The documents of a chunk in id order, their spans, and the distinct (anchor, content) entries of the spans."""

    ids: np.ndarray
    texts: list[bytes]
    ends: np.ndarray
    data: np.ndarray
    first: np.ndarray  # of each span
    last: np.ndarray
    doc: np.ndarray
    entry: np.ndarray
    anchors: np.ndarray  # of each entry; entries are sorted by anchor, so by bucket
    contents: np.ndarray
    entry_ids: np.ndarray  # the smallest document id that holds the entry
    entry_span: np.ndarray  # a span of that document


def chunk_of(table: pa.Table) -> Chunk:
    rows = sorted(zip(table.column("id").to_pylist(), (t.encode() for t in table.column("text").to_pylist())))
    ids = np.array([i for i, _ in rows], np.int64)
    texts = [t for _, t in rows]
    ends = np.cumsum([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts) + bytes(_PAD + WINDOW), np.uint8)
    first, last, anchor, content = spans_of(data, int(ends[-1]), ends)
    anchor, content = anchor >> np.uint64(64 - 8 * _HASH_BYTES), content >> np.uint64(64 - 8 * _SPAN_BYTES)
    doc = np.searchsorted(ends, first, side="right")
    order = np.lexsort((first, content, anchor))  # position order is id order
    a, c = anchor[order], content[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (c[1:] != c[:-1])] if len(order) else np.zeros(0, bool)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    heads = order[new]
    return Chunk(ids, texts, ends, data, first, last, doc, entry, anchor[heads], content[heads], ids[doc[heads]], heads)


def _planes(values: np.ndarray, n_bytes: int) -> bytes:
    """Low bytes of unsigned values, one plane per byte, so that planes of zeros compress away."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n_bytes].T).tobytes()


def _unplaned(data: bytes, n_bytes: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(n_bytes, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :n_bytes] = planes.T
    return wide.view("<u8").ravel()


def _bucket_cuts(anchors: np.ndarray, bits: int) -> np.ndarray:
    """Where each bucket begins among sorted anchors, and the end."""
    return np.searchsorted(anchors, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(8 * _HASH_BYTES - bits))


MESSAGE = "bucket int, chunk int, kind string, a binary, b binary, c binary"
_MESSAGE_ARROW = pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("kind", pa.string()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def _messages(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, _MESSAGE_ARROW)], schema=_MESSAGE_ARROW)


def _ask(table: pa.Table, bits: int) -> pa.Table:
    """A chunk tells each bucket its entries there."""
    chunk = chunk_of(table)
    cuts = _bucket_cuts(chunk.anchors, bits).tolist()
    number = table.column("chunk")[0].as_py()
    ids = (chunk.entry_ids.view(np.uint64)) ^ np.uint64(1 << 63)
    return _messages(
        [
            (bucket, number, "entries", _planes(chunk.anchors[i:j], _HASH_BYTES), _planes(chunk.contents[i:j], _SPAN_BYTES), _planes(ids[i:j], _ID_BYTES))
            for bucket, (i, j) in enumerate(zip(cuts[:-1], cuts[1:]))
            if j > i
        ]
    )


NOTHING, COVERED, COMPARE = 0, 1, 2


def _answer(table: pa.Table) -> pa.Table:
    """A bucket tells each chunk which entries an earlier document has whole, and which need comparing."""
    rows = table.select(["bucket", "chunk", "a", "b", "c"]).to_pylist()
    anchors, contents, ids = (
        np.concatenate([_unplaned(r[name], n) for r in rows]) for name, n in (("a", _HASH_BYTES), ("b", _SPAN_BYTES), ("c", _ID_BYTES))
    )
    order = np.lexsort((ids, contents, anchors))
    a, c = anchors[order], contents[order]
    new_anchor = np.r_[True, a[1:] != a[:-1]]
    new_content = new_anchor | np.r_[True, c[1:] != c[:-1]]
    several = np.add.reduceat(new_content, np.flatnonzero(new_anchor)) > 1
    group = np.cumsum(new_anchor) - 1
    status = np.empty(len(order), np.uint8)
    status[order] = np.where(~new_content, COVERED, np.where(several[group], COMPARE, NOTHING))
    sizes = [len(r["a"]) // _HASH_BYTES for r in rows]
    stops = np.cumsum(sizes).tolist()
    return _messages([(r["bucket"], r["chunk"], "status", status[stop - size : stop].tobytes(), None, None) for r, size, stop in zip(rows, sizes, stops)])


def _statuses(chunk: Chunk, messages: list[dict]) -> np.ndarray:
    found = b"".join(m["a"] for m in sorted((m for m in messages if m["kind"] == "status"), key=lambda m: m["bucket"]))
    if len(found) != len(chunk.anchors):
        raise ValueError("the buckets did not answer for all entries of the chunk")
    return np.frombuffer(found, np.uint8)


def _send(docs: pa.Table, answers: pa.Table, bits: int) -> pa.Table:
    """A chunk passes the statuses on and sends the bytes of spans that need comparing."""
    messages = answers.to_pylist()
    chunk = chunk_of(docs)
    status = _statuses(chunk, messages) if messages else np.zeros(0, np.uint8)
    cuts = _bucket_cuts(chunk.anchors, bits).tolist()
    number = docs.column("chunk")[0].as_py()
    rows = [tuple(m[f.name] for f in _MESSAGE_ARROW) for m in messages]
    for bucket, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
        wanted = np.flatnonzero(status[i:j] == COMPARE)
        if len(wanted):
            span = chunk.entry_span[i + wanted]
            sizes = chunk.last[span] - chunk.first[span] + WINDOW
            body = b"".join(chunk.data[s : s + n].tobytes() for s, n in zip(chunk.first[span].tolist(), sizes.tolist()))
            ids = chunk.entry_ids[i + wanted].astype("<i8").tobytes()
            rows.append((bucket, number, "spans", body, sizes.astype("<u4").tobytes(), wanted.astype("<u4").tobytes() + ids))
    return _messages(rows)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (bytes) in order of at least their first ``depth`` bytes, by two-stage sorting.

    Suffixes smaller than their successor are sorted directly, bucket by first byte. One scan over the buckets in
    order puts each larger suffix right after those of its bucket found so far, since its successor stands before it.
    """
    size = len(text)
    edge = np.flatnonzero(text[1:] != text[:-1])  # last position of each run of one byte but the final run
    runs = np.diff(np.r_[-1, edge, size - 1])
    smaller = np.repeat(np.r_[text[edge] < text[edge + 1], False], runs)
    padded = np.r_[text, np.zeros(depth, np.uint8)]
    windows = np.lib.stride_tricks.as_strided(padded, shape=(size, depth), strides=(1, 1))
    larger: list[list[np.ndarray]] = [[] for _ in range(256)]
    larger[text[-1]].append(np.array([size - 1]))
    out = []

    def induce(suffixes: np.ndarray) -> None:
        before = suffixes[suffixes > 0] - 1
        before = before[~smaller[before]]
        if len(before):
            byte = text[before]
            order = np.argsort(byte, kind="stable")
            before, byte = before[order], byte[order]
            for part in np.split(before, np.flatnonzero(byte[1:] != byte[:-1]) + 1):
                larger[text[part[0]]].append(part)

    for byte in range(256):
        done = 0
        while done < len(larger[byte]):
            induce(larger[byte][done])
            done += 1
        out.extend(larger[byte])
        direct = np.flatnonzero(smaller & (text == byte))
        if len(direct):
            keys = windows[direct].view(f"S{depth}").ravel()
            direct = direct[np.argsort(keys, kind="stable")]
            induce(direct)
            out.append(direct)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Bytes that the strings at ``left`` and ``right`` have in common, up to ``depth``; ``data`` is padded."""
    word = _loads(data)
    common = np.zeros(len(left), np.int64)
    still = np.ones(len(left), bool)
    for offset in range(0, depth, 8):
        differing = word[left + offset] ^ word[right + offset]
        lowest = differing & (~differing + np.uint64(1))
        equal = np.where(differing == 0, 8, np.bitwise_count(lowest - np.uint64(1)) // 8)
        common += np.where(still, equal, 0)
        still &= differing == 0
    return np.minimum(common, depth)


def earliest(text: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each string, a bit mask of its windows that also start in a string of a smaller id."""
    stops = np.cumsum(sizes)
    order = suffix_array(text, WINDOW)
    owner = np.searchsorted(stops, order, side="right")
    whole = order + WINDOW <= stops[owner]
    order, owner = order[whole], owner[whole]
    padded = np.r_[text, np.zeros(_PAD, np.uint8)]
    head = np.r_[True, common_prefixes(padded, order[:-1], order[1:], WINDOW) < WINDOW]
    least = np.minimum.reduceat(ids[owner], np.flatnonzero(head))[np.cumsum(head) - 1]
    later = ids[owner] > least
    offset = (order - (stops - sizes)[owner]).astype(np.uint64)
    masks = np.zeros(len(sizes), np.uint64)
    np.bitwise_or.at(masks, owner[later], np.uint64(1) << offset[later])
    return masks


def _compare(table: pa.Table) -> pa.Table:
    """A bucket sorts the suffixes of all spans it got; statuses pass through."""
    rows = [tuple(m[f.name] for f in _MESSAGE_ARROW) for m in table.to_pylist()]
    out = [r for r in rows if r[2] == "status"]
    rows = [r for r in rows if r[2] == "spans"]
    if rows:
        sizes = [np.frombuffer(r[4], "<u4").astype(np.int64) for r in rows]
        ids = np.concatenate([np.frombuffer(r[5], "<i8", offset=4 * len(s)) for r, s in zip(rows, sizes)])
        masks = earliest(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), np.concatenate(sizes), ids)
        stop = 0
        for r, s in zip(rows, sizes):
            stop += len(s)
            own = masks[stop - len(s) : stop]
            hit = own != 0
            if hit.any():
                out.append((r[0], r[1], "masks", np.frombuffer(r[5], "<u4", count=len(s))[hit].tobytes(), own[hit].astype("<u8").tobytes(), None))
    return _messages(out)


def removed_bytes(chunk: Chunk, messages: list[dict], bits: int) -> np.ndarray:
    """Whether each byte of the chunk's concatenated documents is removed."""
    status = _statuses(chunk, messages) if messages else np.zeros(0, np.uint8)
    whole = (chunk.ids[chunk.doc] > chunk.entry_ids[chunk.entry]) | (status[chunk.entry] == COVERED)
    edge = np.zeros(len(chunk.data) + 1, np.int64)
    np.add.at(edge, chunk.first[whole], 1)
    np.add.at(edge, chunk.last[whole] + WINDOW, -1)
    cuts = _bucket_cuts(chunk.anchors, bits)
    masks = np.zeros(len(chunk.anchors), np.uint64)
    for m in messages:
        if m["kind"] == "masks":
            masks[cuts[m["bucket"]] + np.frombuffer(m["a"], "<u4")] = np.frombuffer(m["b"], "<u8")
    partly = np.flatnonzero(~whole & (masks[chunk.entry] != 0))
    for offset in range(WINDOW - ANCHOR + 1):
        at = partly[(masks[chunk.entry[partly]] >> np.uint64(offset) & np.uint64(1)) == 1]
        np.add.at(edge, chunk.first[at] + offset, 1)
        np.add.at(edge, chunk.first[at] + offset + WINDOW, -1)
    return np.cumsum(edge)[: int(chunk.ends[-1])] > 0


RESULT = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
RESULT_KEPT = RESULT + ", kept binary"


def _finish(docs: pa.Table, messages: pa.Table, bits: int, with_kept: bool) -> pa.Table:
    chunk = chunk_of(docs)
    gone = removed_bytes(chunk, messages.to_pylist(), bits)
    out = []
    start = 0
    for key, text, end in zip(chunk.ids.tolist(), chunk.texts, chunk.ends.tolist()):
        cut = gone[start:end]
        removed = int(cut.sum())
        runs = int((cut[1:] & ~cut[:-1]).sum() + cut[0]) if removed else 0
        kept = np.frombuffer(text, np.uint8)[~cut].tobytes() if removed else text
        out.append((key, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), kept)[: 6 if with_kept else 5])
        start = end
    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: 6 if with_kept else 5]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_kept: bool = False,
    chunk_bytes: int = CHUNK_BYTES,
) -> DataFrame:
    """``(id, n_bytes, n_removed, n_spans, kept_sha256[, kept])`` per document row.

    Each byte of the UTF-8 text covered by a ``WINDOW``-byte string that also starts in a document of a smaller id is
    removed; strings are judged on the input and never cross documents. ``n_spans`` counts maximal removed runs.

    Documents are dealt once to chunks of about ``chunk_bytes`` by a hash of their id. Chunks and buckets of anchors
    exchange packed arrays: entries, statuses, spans that need comparing, masks. A chunk sends one entry for equal
    spans, however often it holds them, and one chunk of all sends the bytes of a span, so a passage that a third of the
    documents share costs its bucket one entry per chunk and one string to sort. Chunks and buckets grow in number with
    the input, not in size. Spans are told apart by 88 bits of hash.

    Ids are integers. Null text counts as empty; documents with a null id lose nothing and take nothing; rows that
    repeat an id never remove each other, each has its own result; an empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_chunks = max(1, -(-total // chunk_bytes))
    bits = max(1, (n_chunks - 1).bit_length())
    chunked = (
        rows.where(F.col("id").isNotNull()).withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(n_chunks)).cast("int")).repartition("chunk")
    )

    def ask(table):
        return _ask(table, bits)

    def send(left, right):
        return _send(left, right, bits)

    def finish(left, right):
        return _finish(left, right, bits, with_kept)

    by_chunk = lambda df: df.groupBy("chunk")
    asked = by_chunk(chunked).applyInArrow(ask, MESSAGE)
    answered = asked.groupBy("bucket").applyInArrow(_answer, MESSAGE)
    sent = by_chunk(chunked).cogroup(by_chunk(answered)).applyInArrow(send, MESSAGE)
    compared = sent.groupBy("bucket").applyInArrow(_compare, MESSAGE)
    known = by_chunk(chunked).cogroup(by_chunk(compared)).applyInArrow(finish, RESULT_KEPT if with_kept else RESULT)
    kept = F.col("text").cast("binary")
    nameless = rows.where(F.col("id").isNull()).select(
        "id",
        F.octet_length("text").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"),
        F.sha2(kept, 256).alias("kept_sha256"),
        *[kept.alias("kept")] * with_kept,
    )
    return known.union(nameless).withColumnRenamed("id", id_col)

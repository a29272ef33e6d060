"""Byte-level BPE by corpus-level merge replay, and decoding.

The distinct pre-tokens of a corpus slice lie in one flat array. An inverted index maps the merge of each adjacent
token pair to its positions; merges are applied in rank order, and a merge touches its two neighbours only.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import base

SLICE_BYTES = 24 << 20
CACHE_WORDS = 1 << 20
BAND = 4096  # ranks whose part of the index is laid out together
_NONE = np.int32(2**31 - 1)  # no merge; also the neighbour of a word's edge


# ASCII and the Latin letters up to U+024F, but the ordinal signs, superscripts and fractions between them.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_ALL_LATIN = re.compile(rf"[\t-\r -~{_LATIN}]*")


def plain_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of ``_ALL_LATIN`` only, which the faster standard module can match."""
    classes = {r"\p{L}": _LATIN, r"\p{N}": "0-9"}

    def spelled(found: re.Match) -> str:
        if found[0] in classes:
            return f"[{classes[found[0]]}]"
        return functools.reduce(lambda text, name: text.replace(name, classes[name]), classes, found[0])

    plain = re.sub(r"\[[^\]]*\]|\\p\{[LN]\}", spelled, pattern)
    return None if "\\p" in plain or "\\P" in plain else re.compile(plain)


class Vocabulary:
    """Ranks of a ``.tiktoken`` file; ids are ranks. Remembers the words encoded so far."""

    def __init__(self, content: bytes, pattern: str):
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.plain = plain_pattern(pattern)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.codes: dict[str, int] = {}
        self.encoded: list[bytes] = []
        known = self.ranks.get
        joined = [
            (left << 32 | right, rank)
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := known(token[:cut])) is not None and (right := known(token[cut:])) is not None
        ]
        joined.sort()
        self._pairs = np.array([p for p, _ in joined] + [2**62], np.int64)
        self._made = np.array([r for _, r in joined] + [_NONE], np.int32)

    def split(self, text: str) -> list[str]:
        plain = self.plain is not None and _ALL_LATIN.fullmatch(text) is not None
        return (self.plain if plain else self.pattern).findall(text)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the token that each two tokens make together, or ``_NONE``."""
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self._pairs, wanted)
        return np.where(self._pairs[at] == wanted, self._made[at], _NONE)


@functools.lru_cache(maxsize=2)
def vocabulary(content: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(content, pattern)


class _Index:
    """Positions by the rank of the merge they wait for, lowest rank first.

    Entries of later bands stay in arrays until their band begins; entries of the current band or below, which
    merges made meanwhile, go to a heap.
    """

    def __init__(self, places: np.ndarray, ranks: np.ndarray):
        self.waiting = [(places, ranks)] if len(places) else []
        self.band_end = 0
        self.heap: list[int] = []
        self.now: dict[int, list[np.ndarray]] = {}

    def add(self, places: np.ndarray, ranks: np.ndarray) -> None:
        early = ranks < self.band_end
        if early.any():
            order = np.argsort(ranks[early], kind="stable")
            self._put(places[early][order], ranks[early][order])
            places, ranks = places[~early], ranks[~early]
        if len(places):
            self.waiting.append((places, ranks))

    def _put(self, places: np.ndarray, ranks: np.ndarray) -> None:
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, group in zip(ranks[np.r_[0, cuts]].tolist(), np.split(places, cuts)):
            if rank not in self.now:
                self.now[rank] = []
                heapq.heappush(self.heap, rank)
            self.now[rank].append(group)

    def pop(self) -> tuple[int, np.ndarray] | None:
        while not self.heap:
            if not self.waiting:
                return None
            places, ranks = (np.concatenate(c) for c in zip(*self.waiting))
            self.band_end = (int(ranks.min()) // BAND + 1) * BAND
            later = ranks >= self.band_end
            self.waiting = [(places[later], ranks[later])] if later.any() else []
            places, ranks = places[~later], ranks[~later]
            order = np.argsort(ranks, kind="stable")
            self._put(places[order], ranks[order])
        rank = heapq.heappop(self.heap)
        groups = self.now.pop(rank)
        return rank, groups[0] if len(groups) == 1 else np.concatenate(groups)


def _stops(
    places: np.ndarray, taken: np.ndarray, own: np.ndarray, rank: int, token: np.ndarray, after: np.ndarray, before: np.ndarray, vocab: Vocabulary
) -> np.ndarray:
    """Places that must wait because a merge before them in their word makes a pair of a lower rank.

    When a place is merged, all taken places before it have been and none after it: its left neighbour is the merged token
    where the taken place before it ends there, its right neighbour still is as it was.
    """
    chosen = places[taken]
    right = after[chosen]
    following, leading = after[right], before[chosen]
    inner, led = following != _NONE, leading != _NONE
    lower = np.zeros(len(chosen), bool)
    lower[inner] = vocab.merged(np.full(int(inner.sum()), rank), token[following[inner]]) < rank
    beside = token[leading[led]]
    beside[np.r_[False, right[:-1] == leading[1:]][led]] = rank
    lower[led] |= vocab.merged(beside, np.full(len(beside), rank)) < rank
    if not lower.any():
        return np.zeros(len(places), bool)
    made = np.zeros(len(places), np.int64)
    made[taken] = lower
    earlier = np.cumsum(made) - made
    first = np.r_[True, own[1:] != own[:-1]]
    return earlier > earlier[first][np.cumsum(first) - 1]


def replay(words: list[bytes], vocab: Vocabulary) -> list[bytes]:
    """Packed token ids of each word, all merges replayed over the whole list in rank order.

    A turn applies a rank at all its places in a word, from the left and without overlaps, up to the first merge that
    makes a pair of a lower rank, with what stands beside it at that moment; the places after that go back into the index and
    the lower rank comes first. So every word sees its merges in the order an encoder of that word alone would
    take: lowest rank first, and from the left.
    """
    if not words:
        return []
    lengths = np.array([len(w) for w in words])
    ends = np.cumsum(lengths)
    size = int(ends[-1])
    token = vocab.single[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    after = np.arange(1, size + 1, dtype=np.int32)
    before = np.arange(-1, size - 1, dtype=np.int32)
    after[ends - 1] = _NONE
    before[ends - lengths] = _NONE
    waits = np.full(size, _NONE, np.int32)  # rank of the pair that begins here
    paired = np.flatnonzero(after != _NONE)
    waits[paired] = vocab.merged(token[paired], token[paired + 1])
    paired = paired[waits[paired] != _NONE].astype(np.int32)
    index = _Index(paired, waits[paired])
    while (entry := index.pop()) is not None:
        rank, places = entry
        places = places[waits[places] == rank]
        if not len(places):
            continue
        if len(places) > 1:
            places = np.sort(places)
            places = places[np.r_[True, places[1:] != places[:-1]]]
        if len(places) > 1:
            own = owner[places]
            follows = np.r_[False, (own[1:] == own[:-1]) & (after[places[:-1]] == places[1:])]
            at = np.arange(len(places))
            taken = (at - np.maximum.accumulate(np.where(follows, 0, at))) % 2 == 0
            if len(own) != int((own[1:] != own[:-1]).sum()) + 1:  # some word has several
                stop = _stops(places, taken, own, rank, token, after, before, vocab)
                if stop.any():
                    again = places[stop]
                    index.add(again, np.full(len(again), rank, np.int32))
                    taken &= ~stop
            places = places[taken]
        right = after[places]
        following = after[right]
        token[places], token[right], waits[right] = rank, -1, _NONE
        after[places] = following
        inner = following != _NONE
        before[following[inner]] = places[inner]
        leading = before[places]
        led = leading != _NONE
        made = np.full(len(places), _NONE, np.int32)
        made[inner] = vocab.merged(token[places[inner]], token[following[inner]])
        leading = leading[led]
        earlier = vocab.merged(token[leading], token[places[led]])
        waits[places], waits[leading] = made, earlier
        touched, ranks = np.r_[places, leading], np.r_[made, earlier]
        useful = ranks != _NONE
        if useful.any():
            index.add(touched[useful], ranks[useful])
    left = token >= 0
    sizes = np.bincount(owner[left], minlength=len(words)) * 4
    packed = token[left].astype("<u4").tobytes()
    stops = np.cumsum(sizes).tolist()
    return [packed[stop - size : stop] for stop, size in zip(stops, sizes.tolist())]


def encode_slice(texts: list[str], vocab: Vocabulary) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers; new words of the slice are replayed together."""
    if len(vocab.encoded) > CACHE_WORDS:
        vocab.codes.clear()
        vocab.encoded.clear()
    codes, numbered = vocab.codes, []
    new: list[str] = []
    for text in texts:
        words = vocab.split(text)
        for word in set(words).difference(codes):
            codes[word] = len(codes)
            new.append(word)
        numbered.append(np.fromiter(map(codes.__getitem__, words), np.int32, len(words)))
    raw = [word.encode() for word in new]
    whole = [vocab.ranks.get(word) for word in raw]
    replayed = iter(replay([word for word, rank in zip(raw, whole) if rank is None], vocab))
    vocab.encoded.extend(next(replayed) if rank is None else rank.to_bytes(4, "little") for rank in whole)
    return [b"".join(map(vocab.encoded.__getitem__, numbers.tolist())) for numbers in numbered]


def decode(ids: bytes, vocab: Vocabulary) -> bytes:
    return b"".join(map(vocab.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encode(batches, content: bytes, pattern: str, slice_bytes: int, finish: Callable, names: list[str], types: list):
    vocab = vocabulary(content, pattern)
    for batch in base.slices(batches, limit=slice_bytes):
        ids = encode_slice(batch.column(1).to_pylist(), vocab)
        columns = finish(ids, vocab)
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, types)], ["id", *names])


def _as_ids(ids: list[bytes], vocab: Vocabulary) -> list:
    return [[len(i) // 4 for i in ids], ids]


def _as_digests(ids: list[bytes], vocab: Vocabulary) -> list:
    return [
        [len(i) // 4 for i in ids],
        [hashlib.sha256(i).hexdigest() for i in ids],
        [hashlib.sha256(decode(i, vocab)).hexdigest() for i in ids],
    ]


def _with_digests(ids: list[bytes], vocab: Vocabulary) -> list:
    return [*_as_digests(ids, vocab), ids]


def _read(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _run(docs: DataFrame, path: str, pattern: str, id_col: str, text_col: str, finish: Callable, out: dict, slice_bytes: int) -> DataFrame:
    rows = base.keyed_text(docs, id_col, text_col)
    names = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in out.items())
    run = base.packaged(
        _encode, content=_read(path), pattern=pattern, slice_bytes=slice_bytes, finish=finish, names=list(out), types=[names[v] for v in out.values()]
    )
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def encode(
    docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES
) -> DataFrame:
    """``(id, n_tokens, ids)`` per document row; ``ids`` are little-endian unsigned 32-bit integers.

    ``path`` is a ``.tiktoken`` file of ranks, ``pattern`` the regular expression that cuts texts into
    pre-tokens; no special tokens. Each task replays the merges over the distinct new words of about
    ``slice_bytes`` of text at a time and remembers up to ``CACHE_WORDS`` of them for the next slices.

    Null text is encoded as empty (no ids); null ids and repeated rows stay, one result row each; an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    return _run(docs, path, pattern, id_col, text_col, _as_ids, {"n_tokens": "long", "ids": "binary"}, slice_bytes)


def round_trip(
    docs: DataFrame,
    path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256[, ids])``: encode as ``encode`` does, then decode the ids."""
    out = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    if with_ids:
        out["ids"] = "binary"
    return _run(docs, path, pattern, id_col, text_col, _with_digests if with_ids else _as_digests, out, slice_bytes)


def _decode(batches, content: bytes, pattern: str):
    vocab = vocabulary(content, pattern)
    for batch in base.slices(batches):
        texts = [None if ids is None else decode(ids, vocab) for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["id", "bytes"])


def decode_ids(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id, bytes)`` for packed ids; null ids give null. Bytes need not be valid UTF-8 where ids were cut."""
    rows = encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, bytes binary"
    return rows.mapInArrow(base.packaged(_decode, content=_read(path), pattern=pattern), schema).withColumnRenamed("id", id_col)

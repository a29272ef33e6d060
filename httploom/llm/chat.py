"""Chat formatting by token-level assembly.

A turn becomes ``<|im_start|> role newline content <|im_end|> newline``. The control marks are reserved ids that no
text can produce: every segment is encoded by itself, and the ids are spliced in between. Loss masks follow
from the prefix sums of the segment lengths.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base, bpe

START, END = "<|im_start|>", "<|im_end|>"
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")

TURN = T.StructType(
    [
        T.StructField("ids", T.BinaryType()),
        T.StructField("loss_start", T.IntegerType()),
        T.StructField("loss_end", T.IntegerType()),
    ]
)


def escape(text: str) -> str:
    """One backslash more in every ``<|``, ``<\\|``, ``<\\\\|`` ...; afterwards no ``<|`` is left."""
    return _OPEN.sub(lambda m: f"<\\{m[1]}|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: f"<{m[1]}|", text)


def escape_role(role: str) -> str:
    """A role ends at the line break, so its own line breaks are spelled out."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def reserved(vocab: bpe.Vocabulary) -> dict[int, str]:
    """Ids after the last rank for the control marks."""
    free = max(vocab.tokens) + 1
    return {free: START, free + 1: END}


def _assemble(batches, content: bytes, pattern: str, slice_bytes: int, trained: tuple[str, ...]):
    vocab = bpe.vocabulary(content, pattern)
    start, end = (np.array([i], "<u4").tobytes() for i in reserved(vocab))
    (newline,) = bpe.encode_slice(["\n"], vocab)
    for batch in base.slices(batches, text=3, limit=slice_bytes):
        roles, texts = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        segments = bpe.encode_slice([*map(escape_role, roles), *map(escape, texts)], vocab)
        ids, lows, highs = [], [], []
        for role, head, body in zip(roles, segments, segments[len(roles) :]):
            parts = [start, head, newline, body, end, newline]
            sums = np.cumsum([len(p) // 4 for p in parts])
            ids.append(b"".join(parts))
            lows.append(int(sums[2]) if role in trained else None)
            highs.append(int(sums[3]) if role in trained else None)
        turns = pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())], ["ids", "loss_start", "loss_end"])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), turns], ["id", "turn", "role", "tokens"])


def format_turns(
    conversations: DataFrame,
    path: str,
    pattern: str,
    trained: tuple[str, ...] = ("assistant",),
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    slice_bytes: int = base.SLICE_BYTES,
) -> DataFrame:
    """``(id, turn, role, tokens)``: ids and loss span of each turn, ``tokens`` = (ids, loss_start, loss_end).

    The ids of a conversation are those of its turns in order. ``[loss_start, loss_end)`` counts tokens within the
    turn and covers the text of a trained role alone; it is null for other roles. Texts and roles have their control
    strings escaped reversibly before encoding.

    Null text and null role count as empty; null ids form one conversation; repeated rows are turns of their own;
    an empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = conversations.select(
        F.col(id_col).alias("id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    schema = T.StructType([rows.schema["id"], rows.schema["turn"], T.StructField("role", T.StringType()), T.StructField("tokens", TURN)])
    with open(path, "rb") as file:
        content = file.read()
    run = base.packaged(_assemble, content=content, pattern=pattern, slice_bytes=slice_bytes, trained=tuple(trained))
    return rows.mapInArrow(run, schema)


READ = T.StructType(
    [
        T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("loss_text", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ]
)
_READ_ARROW = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]


def _decode(batches, content: bytes, pattern: str):
    vocab = bpe.vocabulary(content, pattern)
    marks = reserved(vocab)
    start, end = marks
    spelled = {i: v.encode() for i, v in marks.items()} | vocab.tokens

    def text_of(ids: np.ndarray) -> str:
        return b"".join(map(spelled.__getitem__, ids.tolist())).decode()

    def turn_of(packed: bytes, low: int | None, high: int | None) -> tuple:
        ids = np.frombuffer(packed, "<u4")
        if ids[0] != start or ids[-2] != end:
            raise ValueError("a turn does not begin and end with its control marks")
        role, _, text = text_of(ids[1:-2]).partition("\n")
        loss = None if low is None else unescape(text_of(ids[low:high]))
        return unescape_role(role), unescape(text), loss, len(text_of(ids)), len(ids)

    for batch in batches:
        if batch.num_rows:
            read = zip(*(turn_of(t["ids"], t["loss_start"], t["loss_end"]) for t in batch.column(2).to_pylist()))
            turns = pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(read, _READ_ARROW)], READ.names)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), turns], ["id", "turn", "read"])


def decode_turns(turns: DataFrame, path: str, pattern: str) -> DataFrame:
    """``(id, turn, role, text, loss_text, formatted_chars, n_tokens)`` of formatted turns, read from the ids alone."""
    with open(path, "rb") as file:
        content = file.read()
    schema = T.StructType([turns.schema["id"], turns.schema["turn"], T.StructField("read", READ)])
    decoded = turns.select("id", "turn", "tokens").mapInArrow(base.packaged(_decode, content=content, pattern=pattern), schema)
    return decoded.select("id", "turn", "read.*")


class _Digest:
    """Running digests of one conversation; holds no texts."""

    def __init__(self, key):
        self.key = key
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.n_tokens = 0

    def add(self, role: str, text: str, loss: str | None, chars: int, tokens: int) -> None:
        self.turns.update(f"{role}\n{text}\n".encode())
        self.n_turns += 1
        self.formatted_chars += chars
        self.n_tokens += tokens
        if loss is not None:
            self.loss.update(loss.encode())
            self.loss_chars += len(loss)

    def row(self) -> tuple:
        return self.key, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars, self.n_tokens


def _digests(batches, key_type: pa.DataType):
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"]
    kinds = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    digest = None
    for batch in batches:
        done = []
        for key, *turn in zip(*(c.to_pylist() for c in batch.columns)):
            if digest is None or digest.key != key:
                if digest is not None:
                    done.append(digest.row())
                digest = _Digest(key)
            digest.add(*turn)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), kinds)], names)
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(digest.row(), kinds)], names)


def conversation_digests(decoded: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """One row per conversation: counts and digests of its decoded turns in order.

    Turns are ordered by turn, then role and text, so ties have one order; null turns come first. Sorted turns
    stream through the task: a conversation of any length needs the memory of one Arrow batch.
    """
    key = decoded.schema["id"].dataType
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key.simpleString()]
    schema = f"id {key.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"
    ordered = decoded.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    rows = ordered.select("id", "role", "text", "loss_text", "formatted_chars", "n_tokens")
    return rows.mapInArrow(base.packaged(_digests, key_type=kind), schema).withColumnRenamed("id", id_col)

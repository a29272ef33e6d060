"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import base

PIECE_CHARS = 1 << 16
# A single blank between two ASCII letters: no vocabulary entry and no pre-token reaches over its left edge.
_BOUNDARY = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


@functools.lru_cache(maxsize=2)
def _counter(kind: str, model: bytes) -> Callable[[list[str]], list[int]]:
    if kind == "model":
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(ids) for ids in processor.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model.decode())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def pieces(text: str, limit: int, keep_blank: bool) -> Iterator[str]:
    """Cut a long text at safe boundaries; a stretch without one stays whole.

    ``keep_blank``: whether the blank at the cut stays with the right piece (byte-level vocabularies) or
    is left out, because the encoder puts one before every text (sentencepiece's dummy prefix).
    """
    start = 0
    while len(text) - start > limit:
        cut = _BOUNDARY.search(text, start + limit)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start() if keep_blank else cut.end()
    yield text[start:]


def _count(batches, kind: str, model: bytes, slice_bytes: int, piece_chars: int):
    count = _counter(kind, model)
    for batch in base.slices(batches, limit=slice_bytes):
        parts: list[str] = []
        ends = []
        for text in batch.column(1).to_pylist():
            parts.extend(pieces(text, piece_chars, kind != "model"))
            ends.append(len(parts))
        lengths = count(parts)
        totals, start = [], 0
        for end in ends:
            totals.append(sum(lengths[start:end]))
            start = end
        sizes = base.byte_lengths(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64())], ["id", "n_bytes", "n_tokens"]
        )


def token_counts(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    slice_bytes: int = base.SLICE_BYTES,
    piece_chars: int = PIECE_CHARS,
) -> DataFrame:
    """One row ``(id, n_bytes, n_tokens)`` per document row, as the library for the file at ``path`` counts.

    ``.json`` files are read by tokenizers, ``.model`` files by sentencepiece; no begin, end or added special
    tokens. Each library call gets about ``slice_bytes`` of text; texts over ``piece_chars`` characters are cut
    at blanks that no token spans, and the counts of their pieces add up. The vocabulary file (of fixed size) is
    read on the driver and travels with the function.

    Null text counts as empty (0 tokens); null ids and repeated rows stay as they are, one result row each; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    kind = path.rsplit(".", 1)[-1]
    if kind not in ("json", "model"):
        raise ValueError(f"no library for {path}")
    with open(path, "rb") as file:
        model = file.read()
    rows = base.keyed_text(docs, id_col, text_col)
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    run = base.packaged(_count, kind=kind, model=model, slice_bytes=slice_bytes, piece_chars=piece_chars)
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)

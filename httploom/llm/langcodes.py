"""Language identification with error-correcting output codes.

Each language has a codeword. For each bit a binary n-gram classifier tells the languages whose codeword has the bit from
those that lack it. A text gets the language whose codeword is nearest to its margins under loss-weighted decoding:
logistic loss per bit, weighted by how well the bit's classifier does for that language on the training rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import base

UNKNOWN = "und"
FEATURE_BITS = 16
SIZES = (1, 2, 3, 4)  # bytes of the n-grams
SLICE_BYTES = 2 << 20
PIECE = 1 << 21  # bytes of a long text that are hashed at a time
MAX_LANGS = 512
EXHAUSTIVE = 6  # languages up to which all distinct bits are used
BITS_PER_DOUBLING = 12  # code length for more languages, per doubling of their number
SHORT = 50  # n-grams by which margins of short texts are shrunk
SCALE = 4.0  # size of a usual margin under the loss
AMBIGUOUS = 0.6  # score below which a prediction is ambiguous
_FIXED = 1 << 16  # weights are whole multiples of its inverse, so that sums do not depend on their order
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_LETTER = regex.compile(r"\p{L}")


def letters(text: str | None) -> bytes:
    """Lower-case words of letters and their marks between single blanks; empty without a letter."""
    words = _WORD.findall(text.lower()) if text and _LETTER.search(text) else []
    return f" {' '.join(words)} ".encode() if words else b""


def features(data: bytes) -> Iterator[np.ndarray]:
    """Hashed byte n-grams, each once, in arrays of bounded size."""
    for at in range(0, len(data), PIECE):
        raw = np.frombuffer(data, np.uint8, min(PIECE + max(SIZES) - 1, len(data) - at), at).astype(np.uint32)
        for size in SIZES:
            n = min(PIECE, len(raw) - size + 1)
            if n > 0:
                key = np.full(n, size, np.uint32)
                for k in range(size):
                    key = (key * np.uint32(0x01000193)) ^ raw[k : k + n]
                key = (key ^ (key >> np.uint32(15))) * np.uint32(0x85EBCA6B)
                yield (key >> np.uint32(32 - FEATURE_BITS)).astype(np.int32)


def counts(text: str | None) -> np.ndarray:
    """Occurrences of each feature; all 0 without a letter."""
    out = np.zeros(1 << FEATURE_BITS, np.int64)
    for found in features(letters(text)):
        out += np.bincount(found, minlength=len(out))
    return out


def codewords(n_langs: int, seed: int = 42) -> np.ndarray:
    """Codewords of -1 and 1, one row a language.

    Few languages get every bit that splits them (each split once); more get the random bits whose two nearest codewords
    are farthest apart among a fixed number of draws.
    """
    if n_langs <= EXHAUSTIVE:
        columns = [c for c in itertools.product((1, -1), repeat=n_langs) if c[:1] == (1,) and -1 in c]
        return np.array(columns, np.int64).reshape(len(columns), n_langs).T
    length = BITS_PER_DOUBLING * int(np.ceil(np.log2(n_langs)))
    rng, best, apart = np.random.default_rng(seed), None, -1
    for _ in range(50):
        drawn = rng.choice((-1, 1), (n_langs, length))
        drawn[0, np.abs(drawn.sum(axis=0)) == n_langs] *= -1  # a bit must split the languages
        distance = (length - drawn @ drawn.T) // 2
        least = int(distance[~np.eye(n_langs, dtype=bool)].min())
        if least > apart:
            best, apart = drawn, least
    return best


@dataclass
class Model:
    """Languages, their codewords, feature weights per bit in fixed point, and what decoding needs.

    ``scale`` is the usual size of each bit's margin; ``trust`` weighs the bits of each language and sums to 1.
    """

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, text: str | None) -> np.ndarray | None:
        """Mean log-odds of the n-grams for each bit, shrunk for short texts; none without a letter."""
        found = counts(text)
        held = np.flatnonzero(found)
        if not len(held):
            return None
        return found[held] @ self.weights[held].astype(np.int64) / (_FIXED * float(found.sum() + SHORT))

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language number, score from 0 to 1, and ambiguity of rows of margins.

        The score is the softmax of the weighted losses. A prediction is ambiguous if its score is low or if more bits
        disagree with the codeword than the code can correct.
        """
        n_langs, n_bits = self.code.shape
        if not n_bits:
            return np.zeros(len(margins), np.int64), np.ones(len(margins)), np.zeros(len(margins), bool)
        z = SCALE * margins / self.scale
        loss = np.stack([np.logaddexp(0, -z * word) @ trust for word, trust in zip(self.code, self.trust)], axis=1)
        best = loss.argmin(axis=1)
        score = 1 / np.exp(-n_bits * (loss - loss.min(axis=1, keepdims=True))).sum(axis=1)
        apart = (n_bits - self.code @ self.code.T) // 2
        radius = (int(apart[~np.eye(n_langs, dtype=bool)].min()) - 1) // 2
        wrong = (np.where(margins > 0, 1, -1) != self.code[best]).sum(axis=1)
        return best, score, (score < AMBIGUOUS) | (wrong > radius)


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """Feature counts by language of each slice of rows (lang, text)."""
    for batch in base.slices(batches, limit=SLICE_BYTES):
        held: dict[str, np.ndarray] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            held[lang] = held[lang] + counts(text) if lang in held else counts(text)
        for lang, found in held.items():
            at = np.flatnonzero(found)
            columns = [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(found[at])]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "feature", "n"])


def _weighed(batches, langs: list[str], totals: np.ndarray, code: np.ndarray, alpha: float = 0.5) -> Iterator[pa.RecordBatch]:
    """Packed weights of each feature: the log-odds of its mean share among the languages with a bit and without it."""
    number = {lang: k for k, lang in enumerate(langs)}
    size = totals + alpha * (1 << FEATURE_BITS)
    ones = (code > 0).T / (code > 0).sum(axis=0)[:, None]
    zeros = (code < 0).T / (code < 0).sum(axis=0)[:, None]
    for batch in batches:
        packed = []
        for found in batch.column(1).to_pylist():
            n = np.zeros(len(langs))
            for entry in found:
                n[number[entry["lang"]]] = entry["n"]
            share = (n + alpha) / size
            packed.append(np.rint(_FIXED * np.log((ones @ share) / (zeros @ share))).astype("<i4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["feature", "weights"])


def _judged(batches, model: Model) -> Iterator[pa.RecordBatch]:
    """Per slice and language of the sample: rows, summed margin sizes and right bits."""
    for batch in base.slices(batches, limit=SLICE_BYTES):
        held: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            margins = model.margins(text)
            if margins is not None and lang in model.langs:
                held.setdefault(lang, []).append(margins)
        for lang, rows in held.items():
            margins, word = np.array(rows), model.code[model.langs.index(lang)]
            right = (np.where(margins > 0, 1, -1) == word).sum(axis=0)
            columns = [[lang] * len(word), range(len(word)), [len(rows)] * len(word), np.abs(margins).sum(axis=0).tolist(), right.tolist()]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "bit", "n", "size", "right"])


def sample(rows: DataFrame, per_lang: int) -> DataFrame:
    """``(lang, text)`` of about ``per_lang`` rows ``(id, lang, text)`` of each language (all, if fewer), chosen by a hash of the id."""
    n = F.count(F.lit(1))
    share = rows.groupBy("lang").agg(F.least(F.lit(1.0), per_lang / n).alias("share")).collect()
    if len(share) > MAX_LANGS:
        raise ValueError(f"{len(share)} languages; at most {MAX_LANGS} are learned")
    if not share:
        return rows.select("lang", "text")
    wanted = F.create_map(*[F.lit(v) for row in share for v in row])[F.col("lang")]
    return rows.where((F.xxhash64("id") / float(1 << 64) + 0.5) <= wanted).select("lang", "text")


def fit(rows: DataFrame, per_lang: int = 2000) -> Model:
    """A model of the languages of rows ``(id, lang, text)``, learned from a sample of about ``per_lang`` rows of each.

    Weights depend on feature counts of the sample, decoding on how its margins turn out. The driver sees the finished
    weights: ``2^16`` features of at most ``BITS_PER_DOUBLING * 9`` bits. Rows without a letter teach nothing.
    """
    chosen = base.stored(sample(rows, per_lang), "sample")
    counted = base.stored(chosen.mapInArrow(_counted, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")), "counts")
    totals = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}
    langs = sorted(totals)
    code = codewords(len(langs)) if langs else np.zeros((0, 0), np.int64)
    n_bits = code.shape[1]
    weights = np.zeros((1 << FEATURE_BITS, n_bits), np.int32)
    model = Model(langs, code, weights, np.ones(n_bits), np.full(code.shape, 1 / max(1, n_bits)))
    if not n_bits:
        return model
    by_feature = counted.groupBy("feature").agg(F.collect_list(F.struct("lang", "n")).alias("found"))
    run = base.packaged(_weighed, langs=langs, totals=np.array([totals[v] for v in langs], float), code=code)
    for feature, packed in by_feature.mapInArrow(run, "feature int, weights binary").collect():
        weights[feature] = np.frombuffer(packed, "<i4")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def judge(batches):
        return _judged(batches, shared.value)

    judged = chosen.mapInArrow(judge, "lang string, bit int, n long, size double, right long").groupBy("lang", "bit")
    sizes, right = np.ones(code.shape), np.ones(code.shape)
    for lang, bit, n, size, hits in judged.agg(F.sum("n"), F.sum("size"), F.sum("right")).collect():
        sizes[langs.index(lang), bit], right[langs.index(lang), bit] = size / n, hits / n
    shared.unpersist()
    trust = np.maximum(right, 1e-3)
    model.scale = np.maximum(np.round(sizes.mean(axis=0), 9), 1e-9)
    model.trust = trust / trust.sum(axis=1, keepdims=True)
    return model


PREDICTED = {"lang_pred": pa.string(), "score": pa.float64(), "ambiguous": pa.bool_()}


def _predicted(batches, broadcast, text_at: int) -> Iterator[pa.RecordBatch]:
    model: Model = broadcast.value
    for batch in base.slices(batches, text=text_at, limit=SLICE_BYTES):
        found = [model.margins(text) for text in batch.column(text_at).to_pylist()]
        known = [i for i, m in enumerate(found) if m is not None and model.langs]
        langs, scores, unsure = [UNKNOWN] * len(found), [0.0] * len(found), [True] * len(found)
        if known:
            best, score, ambiguous = model.decode(np.array([found[i] for i in known]))
            for i, b, s, a in zip(known, best.tolist(), score.tolist(), ambiguous.tolist()):
                langs[i], scores[i], unsure[i] = model.langs[b], round(s, 6), a
        columns = [pa.array(c, k) for c, k in zip((langs, scores, unsure), PREDICTED.values())]
        kept = [c for c in range(batch.num_columns) if c != text_at]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *columns], [*(batch.schema.names[c] for c in kept), *PREDICTED])


def predict(rows: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of ``rows`` but the text, with ``lang_pred``, ``score`` (0 to 1) and ``ambiguous``; only the text decides."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in rows.schema.fields if f.name != text_col]
    kinds = [T.StringType(), T.DoubleType(), T.BooleanType()]
    schema = T.StructType([*fields, *(T.StructField(n, k) for n, k in zip(PREDICTED, kinds))])
    return rows.mapInArrow(base.packaged(_predicted, broadcast=shared, text_at=rows.columns.index(text_col)), schema)


def identify(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = 2000
) -> DataFrame:
    """``(id, held_out, lang_pred, score, ambiguous)`` per document row, learned from the rows that ``held_out`` is false for.

    The classifier is fitted on a hashed sample of about ``per_lang`` rows of each non-null language; every row is predicted,
    from its whole text and nothing else.

    Text that is null or has no letter is ``und`` with score 0 and ambiguous, as is every text if nothing was learned; with one
    learned language every text with a letter is that language with score 1. Rows whose ``held_out`` is null (as for a null id)
    teach nothing and count as not held out; repeated rows are predicted each; an empty table gives no rows; other columns
    are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    model = fit(rows.where("lang is not null and text is not null and not held_out").select("id", "lang", "text"), per_lang)
    found = predict(rows.select("id", F.coalesce("held_out", F.lit(False)).alias("held_out"), "text"), model)
    return found.withColumnRenamed("id", id_col)

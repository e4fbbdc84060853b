"""Operator 5, language identification.

Averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy, with
calibrated rejection. Subwords are the UTF-8 byte n-grams of a lower-cased text inside its words and at their ends.

Defined results: a null, empty or letterless text gets ``und``, score 0 and is rejected; a null id is scored but
never learned from; repeated rows are scored alike; an empty table, or one without labelled rows, gives every text
with letters ``und`` with score 0, as nothing was learned. Other columns of the table are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklore.llm.common import give_back, id_remainder, kept_names, packed, smallest_hashes, strings, texts_for_python, unpacked

UNKNOWN = "und"
ORDERS = (2, 3, 4)
SPACE = 32
LETTER = re.compile(r"[^\W\d_]")


def _byte_classes() -> np.ndarray:
    """ASCII letters and the bytes of other characters stay; every other ASCII byte separates words."""
    classes = np.full(256, SPACE, np.uint8)
    for low, high in ((97, 122), (128, 255)):
        classes[low:high + 1] = np.arange(low, high + 1)
    return classes


def subwords(texts: list[str], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram order: the bucket of every byte position of the joined texts, and where each text starts.

    Positions whose n-gram crosses a word end get the extra bucket ``2 ** bits``. Every text is followed by a
    separator, so no n-gram reaches into the next one.
    """
    pieces = [b" " + text.lower().encode("utf-8", "replace") + b"    " for text in texts]
    starts = np.cumsum([0] + [len(piece) for piece in pieces[:-1]])
    data = _byte_classes()[np.frombuffer(b"".join(pieces), np.uint8)]
    space, wide = data == SPACE, data.astype(np.uint32)
    out = []
    for order in ORDERS:
        size = len(data) - order + 1
        mixed = np.full(size, order, np.uint32)
        for step in range(order):
            mixed = mixed * np.uint32(0x01000193) ^ wide[step:size + step]
        mixed *= np.uint32(0x9E3779B1)
        buckets = (mixed >> np.uint32(32 - bits)).astype(np.int32)
        across = space[:size] & space[1:size + 1]
        for step in range(1, order - 1):
            across |= space[step:size + step]
        buckets[across] = 1 << bits
        out.append((buckets, starts))
    return out


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    bits: int
    weights: np.ndarray  # (2 ** bits + 1, languages): embeddings times the output layer; the last row is zero
    bias: np.ndarray
    scale: float  # inverse temperature found on validation rows
    reject_below: float

    def score(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities, one row per text."""
        if not texts:
            return np.zeros((0, len(self.languages)))
        sums = np.zeros((len(texts), len(self.languages)))
        counts = np.zeros(len(texts))
        for buckets, starts in subwords(texts, self.bits):
            counts += np.add.reduceat((buckets < 1 << self.bits).astype(np.int32), starts)
            for number in range(len(self.languages)):
                sums[:, number] += np.add.reduceat(self.weights[:, number][buckets], starts, dtype=np.float64)
        return _softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) * self.scale)


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return raised / raised.sum(axis=-1, keepdims=True)


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], bits: int, dimensions: int = 16, epochs: int = 6,
          rate: float = 0.5, seed: int = 7, wrong_reject_rate: float = 0.0005) -> LanguageModel:
    """Fit on (language, buckets, relative counts); every fifth sample only calibrates.

    The temperature minimises the log loss of the calibration samples. The rejection bound is the score below which
    at most ``wrong_reject_rate`` of the rightly predicted calibration samples lie, halved: few of them exist that far out.
    """
    languages = sorted({language for language, _, _ in samples})
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 1 / dimensions, (1 << bits, dimensions)).astype(np.float32)
    out = np.zeros((dimensions, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    rows = [(languages.index(language), buckets, shares) for language, buckets, shares in samples]
    held = [row for number, row in enumerate(rows) if number % 5 == 4] or rows
    learned = [row for number, row in enumerate(rows) if number % 5 != 4] or rows
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for number in rng.permutation(len(learned)):
            truth, buckets, shares = learned[number]
            vectors = table[buckets]
            hidden = shares @ vectors
            error = _softmax(hidden @ out + bias)
            error[truth] -= 1
            back = out @ error
            # A share is about 1 / length, so rows would hardly move; their step is scaled by the root of the length.
            table[buckets] = vectors - step * len(buckets) ** 0.5 * shares[:, None] * back
            out -= step * np.outer(hidden, error)
            bias -= step * 0.1 * error
    weights = np.vstack([table @ out, np.zeros((1, len(languages)), np.float32)])
    logits = np.array([shares @ weights[buckets] + bias for _, buckets, shares in held])
    truths = np.array([truth for truth, _, _ in held])
    scales = 2.0 ** np.arange(-2, 7, 0.5)
    losses = [-np.log(np.maximum(_softmax(logits * scale)[np.arange(len(held)), truths], 1e-9)).mean() for scale in scales]
    scale = float(scales[int(np.argmin(losses))])
    scores = _softmax(logits * scale)
    right = scores.max(axis=1)[scores.argmax(axis=1) == truths]
    bound = float(np.quantile(right, wrong_reject_rate)) / 2 if len(right) else 0.0
    return LanguageModel(languages, bits, np.ascontiguousarray(weights), bias, scale, bound)


def fit(documents: DataFrame, per_language: int = 600, bits: int = 16) -> LanguageModel | None:
    """Learn from the ``per_language`` labelled documents of each language with the smallest id hash.

    That bound is what the driver holds: ``per_language`` sparse vectors of at most 3 * 2 ** bits entries each, made in the
    executors from whole texts. Rows with crc32(id) mod 4 = 2, null ids, null languages and letterless texts are not used.
    """
    usable = documents.filter(F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), 4) != 2) & F.col("text").isNotNull())
    chosen = smallest_hashes(usable.select("doc_id", "lang"), "lang", per_language).select(F.col("doc_id").alias("chosen_id"))
    # At most per_language rows a language, so the side to broadcast is bounded by the parameter.
    rows = usable.select("doc_id", "text", "lang").join(F.broadcast(chosen.distinct()), F.col("doc_id") == F.col("chosen_id"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, text, language in zip(strings(batch, "doc_id"), strings(batch, "text"), strings(batch, "lang"), strict=True):
                if LETTER.search(text):
                    buckets = np.concatenate([bucket for bucket, _ in subwords([text], bits)])
                    unique, counts = np.unique(buckets[buckets < 1 << bits], return_counts=True)
                    found.append((doc_id, language, unique.astype(np.int32), (counts / counts.sum()).astype(np.float32)))
            if found:
                ids, languages, buckets, shares = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array(languages, pa.string()), pa.array(buckets, pa.list_(pa.int32())),
                    pa.array(shares, pa.list_(pa.float32()))], names=["doc_id", "lang", "buckets", "shares"])
            give_back()

    kept = texts_for_python(rows).mapInArrow(vectors, "doc_id long, lang string, buckets array<int>, shares array<float>").toArrow()
    order = np.argsort(kept.column("doc_id").to_numpy(), kind="stable")
    samples = []
    for number in order:
        language, buckets, shares = (kept.column(name)[int(number)] for name in ("lang", "buckets", "shares"))
        samples.append((language.as_py(), buckets.values.to_numpy(), shares.values.to_numpy()))
    return train(samples, bits) if samples else None


def identify(documents: DataFrame, model: LanguageModel | None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id``, the columns in ``keep``, ``lang_pred``, ``score`` and ``rejected``; one output row per input row, whole texts."""
    kept = documents.select("doc_id", *keep, F.col("text").alias("lid_text"))
    schema = pa.schema([("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])
    result = T.StructType([*kept.schema[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("rejected", T.BooleanType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                texts = strings(part, "lid_text")
                lettered = [number for number, text in enumerate(texts) if text and LETTER.search(text)] if model else []
                languages, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if lettered:
                    found = model.score([texts[number] for number in lettered])
                    for number, best, score in zip(lettered, found.argmax(axis=1), found.max(axis=1), strict=True):
                        languages[number], scores[number] = model.languages[best], float(score)
                rejected = [language == UNKNOWN or score < model.reject_below for language, score in zip(languages, scores, strict=True)]
                mine = [pa.array(values, field.type) for values, field in zip((languages, scores, rejected), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *mine], names=[*part.schema.names[:-1], *schema.names])
                give_back()

    return texts_for_python(kept).mapInArrow(predict, result)


def parts(batch: pa.RecordBatch, at_most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about ``at_most`` text bytes (one row at least), so the arrays of positions stay small."""
    lengths = np.diff(np.frombuffer(batch.column(batch.num_columns - 1).cast(pa.large_string()).buffers()[1], np.int64,
                                    batch.num_rows + 1, batch.column(batch.num_columns - 1).cast(pa.large_string()).offset * 8))
    begin, size = 0, 0
    for number, length in enumerate(lengths):
        if number > begin and size + length > at_most:
            yield batch.slice(begin, number - begin)
            begin, size = number, 0
        size += int(length)
    if begin < batch.num_rows:
        yield batch.slice(begin)


def language_query(documents: DataFrame) -> DataFrame:
    """The contract of op5: every document with its prediction."""
    model = fit(documents)
    held = documents.select("doc_id", "text").withColumn("held_out", F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False)))
    return identify(held, model, keep=("held_out",)).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def keep_identified(documents: DataFrame) -> DataFrame:
    """Pipeline stage: documents that the model rejects go; all others keep their columns."""
    model = fit(documents)
    names = documents.columns
    found = identify(packed(documents, "doc_id", "text"), model, keep=tuple(kept_names(names)))
    return unpacked(found.filter(~F.col("rejected")), names)

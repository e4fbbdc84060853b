"""Operator 1, toxicity.

A factorization machine over hashed terms: a weight for every term and a vector whose inner products weigh pairs of terms,
so an insult counts differently beside the mention of a group than alone. A term is a lower-cased word or its first four, five
or six letters, present or absent in the whole text.

Defined results: a null or empty text has no term and gets the score of the bias alone; a null id is scored but never learned
from; repeated label rows count once, the highest label of an id holds; without labels of both kinds every score is 0.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import id_remainder, smallest_hashes, strings

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)
HASH_BITS = 28
CACHE_ENTRIES = 200_000


def hashed_terms(token: str) -> set[int]:
    """Hashes of the words in a lower-cased token, and of their beginnings."""
    found = set()
    for word in WORD.findall(token):
        found.add(zlib.crc32(word.encode()) >> 32 - HASH_BITS)
        for length in PREFIXES:
            if len(word) > length:
                found.add(zlib.crc32(b"^" + word[:length].encode()) >> 32 - HASH_BITS)
    return found


class TermSlots(dict):
    """Token to the model slots of its terms; a bounded memory of tokens already hashed."""

    def __init__(self, slots: dict[int, int] | None):
        super().__init__()
        self.slots = slots

    def __missing__(self, token: str) -> tuple[int, ...]:
        terms = hashed_terms(token)
        found = tuple(terms) if self.slots is None else tuple(self.slots[term] for term in terms if term in self.slots)
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        self[token] = found
        return found

    def of(self, text: str | None) -> set[int]:
        found: set[int] = set()
        for token in set((text or "").lower().split()):
            if slots := self[token]:
                found.update(slots)
        return found


@dataclass(frozen=True)
class FactorizationMachine:
    slots: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, active: np.ndarray) -> float:
        factors = self.factors[active]
        total = factors.sum(axis=0)
        return float(self.bias + self.weights[active].sum() + 0.5 * (total @ total - (factors * factors).sum()))

    def score(self, active: set[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(np.fromiter(active, np.int64, len(active))), -30, 30))))


def screened(samples: list[tuple[int, np.ndarray]], terms: int, least: int) -> dict[int, int]:
    """The ``terms`` hashes whose presence says most about the label (likelihood ratio), seen in ``least`` samples or more.

    A long text has thousands of words that say nothing; without them its score does not drift with its length.
    """
    labels = np.repeat([label for label, _ in samples], [len(found) for _, found in samples])
    values, inverse = np.unique(np.concatenate([found for _, found in samples]), return_inverse=True)
    present = np.stack([np.bincount(inverse[labels == label], minlength=len(values)) for label in (0, 1)]).astype(float)
    sizes = np.array([sum(label == wanted for label, _ in samples) for wanted in (0, 1)], float)[:, None]
    absent, total = sizes - present, sizes.sum()

    def part(observed: np.ndarray, side: np.ndarray) -> np.ndarray:
        return observed * np.log(np.maximum(observed, 1e-12) * total / np.maximum(sizes * side, 1e-12))

    gain = 2 * (part(present, present.sum(0)) + part(absent, absent.sum(0))).sum(0)
    gain[present.sum(0) < least] = -1
    best = np.lexsort((values, -gain))[:terms]
    return {int(values[number]): slot for slot, number in enumerate(best) if gain[number] > 10}


def train(samples: list[tuple[int, np.ndarray]], terms: int = 4096, least: int = 5, rank: int = 4, epochs: int = 12,
          rate: float = 0.1, decay: float = 1e-4, seed: int = 11) -> FactorizationMachine | None:
    """Fit on (label, term hashes) by adaptive gradient steps on the log loss; every label kind weighs half."""
    sizes = [sum(label == wanted for label, _ in samples) for wanted in (0, 1)]
    if not all(sizes):
        return None
    slots = screened(samples, terms, least)
    rows = [(label, np.array([slots[term] for term in found.tolist() if term in slots], np.int64)) for label, found in samples]
    rng = np.random.default_rng(seed)
    bias, weights = -1.0, np.zeros(len(slots))
    factors = rng.normal(0, 0.01, (len(slots), rank))
    seen = [1e-8, np.full(len(slots), 1e-8), np.full((len(slots), rank), 1e-8)]
    for _ in range(epochs):
        for number in rng.permutation(len(rows)):
            label, active = rows[number]
            own = factors[active]
            total = own.sum(axis=0)
            raw = bias + weights[active].sum() + 0.5 * (total @ total - (own * own).sum())
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label) * len(rows) / (2 * sizes[label])
            seen[0] += error * error
            bias -= rate * error / seen[0] ** 0.5
            if len(active):
                slope = error + decay * weights[active]
                seen[1][active] += slope * slope
                weights[active] -= rate * slope / np.sqrt(seen[1][active])
                slopes = error * (total - own) + decay * own
                seen[2][active] += slopes * slopes
                factors[active] = own - rate * 0.3 * slopes / np.sqrt(seen[2][active])
    return FactorizationMachine(slots, float(bias), weights, factors)


def fit(documents: DataFrame, labels: DataFrame, toxic_rows: int = 3000, clean_rows: int = 5000) -> FactorizationMachine | None:
    """Learn from at most ``toxic_rows`` and ``clean_rows`` labelled documents, those with the smallest id hashes.

    Rows with crc32(id) mod 5 = 0 are never learned from. The executors turn whole texts into term hashes; the driver holds
    those of the bounded sample only.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & (id_remainder(F.col("doc_id"), 5) != 0))
    known = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    wanted = F.when(F.col("label") == 1, toxic_rows).otherwise(clean_rows)
    chosen = smallest_hashes(known, "label", wanted).withColumnRenamed("doc_id", "chosen_id")
    # The sample is bounded by its two parameters, so broadcasting it is too.
    rows = documents.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermSlots(None)
        for batch in batches:
            found = [sorted(terms.of(text)) for text in strings(batch, "text")]
            yield pa.RecordBatch.from_arrays([
                pa.array(strings(batch, "doc_id"), pa.int64()), pa.array(strings(batch, "label"), pa.int32()),
                pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "label", "terms"])

    kept = rows.select("doc_id", "label", "text").mapInArrow(hashes, "doc_id long, label int, terms array<int>").toArrow()
    order = np.argsort(kept.column("doc_id").to_numpy(), kind="stable")
    labels_of, terms_of = kept.column("label"), kept.column("terms")
    samples = [(labels_of[int(number)].as_py(), terms_of[int(number)].values.to_numpy()) for number in order]
    return train(samples)


def toxicity(documents: DataFrame, model: FactorizationMachine | None) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document; one pass, no shuffle."""
    rows = documents.select("doc_id", F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = TermSlots(model.slots if model else {})
        for batch in batches:
            scores = np.array([model.score(terms.of(text)) if model else 0.0 for text in strings(batch, "text")])
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def toxicity_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract of op1: every document scored by a model learned from the rows that are not held out."""
    return toxicity(documents, fit(documents, labels))

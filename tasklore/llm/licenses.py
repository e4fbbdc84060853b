"""Operator 9, licence scans with a trained paragraph classifier.

Paragraphs, and their lines, are read in windows of at most ``WINDOW`` words with half overlap, so a notice inside a long paragraph is not diluted. A sparse logistic
regression over word one- to three-grams, trained here on varied templates and on windows of the corpus, names the family or the unknown
class; its temperature and the bound below which a window counts as unknown are calibrated on windows it has not seen. A predicted family
is confirmed if the window holds most three-grams of one of its templates.

Defined results: a null or empty text has no licence; null ids and repeated rows are scanned row by row; on an empty table the model is
trained on the templates alone and there are no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import strings
from tasklore.llm.license_texts import OTHER, TEMPLATES

WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
WINDOW = 48
ORDERS = (1, 2, 3)
CONFIRM = 0.6
UNKNOWN = "unknown"
LEADERS = ("dnl", "rem")


def grams(words: list[str], orders: tuple[int, ...] = ORDERS) -> set[str]:
    return {" ".join(words[at:at + order]) for order in orders for at in range(len(words) - order + 1)}


def paragraphs(text: str | None) -> list[list[list[str]]]:
    """The words of each line of each paragraph. Lines without words part paragraphs; comment leaders are marks, or one of ``LEADERS``."""
    found: list[list[list[str]]] = [[]]
    for line in (text or "").lower().split("\n"):
        words = WORD.findall(line)
        words = words[1:] if words and words[0] in LEADERS else words
        if words:
            found[-1].append(words)
        elif found[-1]:
            found.append([])
    return [lines for lines in found if lines]


TEMPLATE_GRAMS = {family: [grams(WORD.findall(text.lower()), (3,)) for text in texts] for family, texts in TEMPLATES.items()}


def likeness(family: str, words: list[str]) -> float:
    """The largest share of a template's three-grams that the words hold."""
    found = grams(words, (3,))
    return max(len(template & found) / len(template) for template in TEMPLATE_GRAMS[family])


def extent(family: str, words: list[str]) -> tuple[float, int, int]:
    """The likeness, and where the three-grams of the likest template begin and end; all words if there are none."""
    found = [" ".join(words[at:at + 3]) for at in range(len(words) - 2)]
    template = max(TEMPLATE_GRAMS[family], key=lambda template: len(template.intersection(found)) / len(template))
    places = [at for at, gram in enumerate(found) if gram in template]
    return len(template.intersection(found)) / len(template), places[0] if places else 0, places[-1] + 3 if places else len(words)


@dataclass(frozen=True)
class LicenseModel:
    families: list[str]
    features: dict[str, int]
    weights: np.ndarray
    bias: np.ndarray
    scale: float
    bound: float

    def windows(self, words: list[str]) -> list[set[int]]:
        """The features of every window of ``WINDOW`` words with half overlap. Grams are looked up only where all their words are known."""
        step = WINDOW // 2
        found: list[set[int]] = [set() for _ in range(0, max(1, len(words) - step), step)]
        known = [word in self.features for word in words] + [False] * (ORDERS[-1] - 1)
        for at in range(len(words)):
            for order in ORDERS:
                if not known[at + order - 1]:
                    break
                number = self.features.get(" ".join(words[at:at + order]))
                if number is not None:
                    late = at // step
                    if late < len(found):
                        found[late].add(number)
                    if late and at + order <= (late + 1) * step:
                        found[late - 1].add(number)
        return found

    def judge(self, windows: list[set[int]]) -> list[tuple[str, float]]:
        """Likeliest family and score of each window; one without a known n-gram is unknown. The bound is left to the caller."""
        out = [(UNKNOWN, 0.0)] * len(windows)
        filled = [number for number, window in enumerate(windows) if window]
        if not filled:
            return out
        starts = np.cumsum([0] + [len(windows[number]) for number in filled[:-1]])
        features = [feature for number in filled for feature in sorted(windows[number])]
        logits = (self.bias + np.add.reduceat(self.weights[features], starts, axis=0)) * self.scale
        shares = np.exp(logits - logits.max(axis=1, keepdims=True))
        shares /= shares.sum(axis=1, keepdims=True)
        for number, best, score in zip(filled, shares.argmax(axis=1).tolist(), shares.max(axis=1).tolist(), strict=True):
            out[number] = (self.families[best], score)
        return out

    def scan(self, text: str | None) -> list[tuple[str, float, bool]]:
        """(family, score, confirmed) of each paragraph's windows that are not unknown; windows of a paragraph with the same family count once.

        A paragraph of several lines is read as a whole and line by line: the first finds wrapped notices, the second keeps a short one undiluted.
        A window that holds a mere piece of another family's confirmed notice does not count.
        """
        windows = []  # (paragraph, place in it, words, features)
        for number, lines in enumerate(paragraphs(text)):
            place, stretches = 0, [(0, [word for line in lines for word in line])]
            for line in lines if len(lines) > 1 else []:
                stretches.append((place, line))
                place += len(line)
            windows += [(number, start + begin, words[begin:begin + WINDOW], features) for start, words in stretches
                        for begin, features in zip(range(0, len(words), WINDOW // 2), self.windows(words), strict=False)]
        notices = []  # (paragraph, first word, end, family, score, likeness)
        for (number, place, words, _), (family, score) in zip(windows, self.judge([window[-1] for window in windows]), strict=True):
            if family != UNKNOWN:
                like, first, end = extent(family, words)
                if score >= self.bound or like == 1:  # the bound is for doubtful windows, and one with a whole template is none
                    notices.append((number, place + first, place + end, family, score, like))
        sure: dict[tuple[int, int], set[tuple]] = {}
        for number, first, end, family, _, like in notices:
            if like >= CONFIRM:
                sure.setdefault((number, first // WINDOW), set()).add((first, end, family, like))
        hits: dict[tuple[int, str], tuple[float, bool]] = {}
        for number, first, end, family, score, like in notices:
            near = [notice for back in (0, 1) for notice in sure.get((number, first // WINDOW - back), ())]
            if not any(begin <= first and end <= until and other != family and like < most for begin, until, other, most in near):
                old = hits.get((number, family), (0.0, False))
                hits[number, family] = (max(score, old[0]), old[1] or like >= CONFIRM)
        return [(family, score, confirmed) for (_, family), (score, confirmed) in hits.items()]


def _varied(template: list[str], filler: list[list[str]], rng: np.random.Generator) -> list[str]:
    """A template as texts hold it: now and then a word missing or the end cut, between other words."""
    kept = [word for word in template if rng.random() > 0.04] if len(template) > 5 else list(template)
    if rng.random() < 0.2 and len(kept) > 8:
        kept = kept[:int(len(kept) * rng.uniform(0.7, 1))]
    around = filler[rng.integers(len(filler))] if filler and rng.random() < 0.6 else []
    cut = int(rng.integers(0, len(around) + 1))
    return around[:cut][-20:] + kept + around[cut:][:20]


def train(corpus: list[list[str]], per_template: int = 40, epochs: int = 8, rate: float = 0.3, false_rate: float = 0.0005, seed: int = 3) -> LicenseModel:
    """Fit on varied templates and on corpus windows that resemble no template; a fifth of both is kept for calibration.

    Features are the n-grams of the templates; all others have weight zero, which keeps the model sparse and a scan cheap.
    """
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    plain = [words for words in corpus if max(likeness(family, words) for family in TEMPLATES) < 0.3]
    rows = [(number, _varied(WORD.findall(text.lower()), plain, rng)) for number, texts in enumerate(TEMPLATES.values())
            for text in texts for _ in range(per_template)]
    others = plain + [_varied(WORD.findall(text.lower()), plain, rng) for text in OTHER for _ in range(per_template)]
    for texts in TEMPLATES.values():  # the words of a template in another order declare nothing
        for text in texts:
            others += [list(rng.permutation(WORD.findall(text.lower()))) for _ in range(5)]
    rows += [(len(families) - 1, words) for words in others]
    vocabulary = sorted(set().union(*(grams(WORD.findall(text.lower())) for texts in TEMPLATES.values() for text in texts)))
    features = {gram: number for number, gram in enumerate(vocabulary)}
    listed = [(truth, np.array([features[gram] for gram in grams(words) if gram in features], np.int64)) for truth, words in rows]
    order = rng.permutation(len(listed))
    held = [listed[number] for number in order[::5]]
    learned = [listed[number] for place, number in enumerate(order) if place % 5]
    weights, bias = np.zeros((len(features), len(families))), np.zeros(len(families))
    seen = np.full(weights.shape, 1e-6)
    for _ in range(epochs):
        for number in rng.permutation(len(learned)):
            truth, found = learned[number]
            logits = bias + weights[found].sum(axis=0)
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[truth] -= 1
            seen[found] += error * error
            weights[found] -= rate * error / np.sqrt(seen[found])
            bias -= 0.02 * error
    logits = np.array([bias + weights[found].sum(axis=0) for _, found in held])
    truths = np.array([truth for truth, _ in held])

    def shares(scale: float) -> np.ndarray:
        raised = np.exp((logits - logits.max(axis=1, keepdims=True)) * scale)
        return raised / raised.sum(axis=1, keepdims=True)

    scales = 2.0 ** np.arange(-4, 3.1, 0.5)
    losses = [-np.log(np.maximum(shares(scale)[np.arange(len(held)), truths], 1e-9)).mean() for scale in scales]
    scale = float(scales[int(np.argmin(losses))])
    wrong = shares(scale)[truths == len(families) - 1][:, :-1].max(axis=1)
    bound = max(0.5, float(np.quantile(wrong, 1 - false_rate))) if len(wrong) else 0.5
    return LicenseModel(families, features, weights, bias, scale, min(bound, 0.95))


def fit(documents: DataFrame, sample_rows: int = 2000, windows_per_row: int = 2) -> LicenseModel:
    """Learn the unknown class from windows of the ``sample_rows`` documents with the smallest id hash; labels are not needed."""
    chosen = documents.filter("text is not null and doc_id is not null").select("doc_id").orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample_rows)
    picked = chosen.distinct().withColumnRenamed("doc_id", "chosen_id")  # bounded by sample_rows, hence broadcast
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("chosen_id"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, windows = [], []
            for doc_id, text in zip(strings(batch, "doc_id"), strings(batch, "text"), strict=True):
                words = WORD.findall(text.lower())
                rng = np.random.default_rng(abs(doc_id))
                for _ in range(windows_per_row if words else 0):
                    begin = int(rng.integers(max(1, len(words) - WINDOW)))
                    ids.append(doc_id)
                    windows.append(words[begin:begin + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(windows, pa.list_(pa.string()))], names=["doc_id", "words"])

    found = rows.select("doc_id", "text").mapInArrow(cut, "doc_id long, words array<string>").toArrow()
    return train(sorted(found.column("words").to_pylist()))


def scan(documents: DataFrame, model: LicenseModel) -> DataFrame:
    """``doc_id``, ``licenses`` (confirmed families), ``unconfirmed`` (other predicted ones), ``n_notices`` and ``score`` of every document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sure, unsure, counts, scores = [], [], [], []
            for text in strings(batch, "text"):
                found = model.scan(text)
                confirmed = {family for family, _, yes in found if yes}
                sure.append(",".join(sorted(confirmed)))
                unsure.append(",".join(sorted({family for family, _, _ in found} - confirmed)))
                counts.append(len(found))
                scores.append(max((score for _, score, _ in found), default=0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sure, pa.string()), pa.array(unsure, pa.string()), pa.array(counts, pa.int64()),
                                              pa.array(scores, pa.float64())], names=["doc_id", "licenses", "unconfirmed", "n_notices", "score"])

    return documents.select("doc_id", "text").mapInArrow(read, "doc_id long, licenses string, unconfirmed string, n_notices long, score double")


def license_query(documents: DataFrame) -> DataFrame:
    return scan(documents, fit(documents))

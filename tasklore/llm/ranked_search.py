"""Operator 13, ranked lexical search with range-maximum tables over posting lists.

The index is one row per text with its length and its counts of the terms that are asked for. A task takes some thousand texts at a
time, orders them by length and lays out one posting list a term with the impact of the term in each text, and over each list a
sparse table that gives the greatest impact in any range. A range of texts can score no more than the sum of its maxima.
Ranges are opened best first, a block at a time: the text with the greatest impact is scored, the range falls into the two
parts around it, and each part is bounded anew; short ranges are scored whole. A query ends when no bound reaches its worst kept
score. That score is carried on to the next texts of the task, so most later ranges are never opened.

Every query meets every text, in blocks of queries of bounded size; of a task only the best texts of each query leave.

Defined results: null and texts without a term are counted nowhere and never found; rows that repeat an id are texts each, a null id
comes after all others; repeated rows of an item add nothing, different texts of one item are one query, each text without an
item id is one of its own; items without a term and empty tables give no rows; columns of other names are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklore.llm.common import written

TOP = 10
BLOCK_ITEMS = 2_000  # queries of one pass over the index
SHARD_TEXTS = 16_384  # texts laid out at a time
OPENED, SHORT = 256, 16  # ranges opened at once; texts of a range that is scored whole
NO_ID = (1 << 63) - 1

_LETTERS = bytes(byte if byte >= 128 or chr(byte).isalnum() else 32 for byte in range(256))
_INDEX = "doc_id long, length long, terms array<int>, counts array<int>"


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a text in order: runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased."""
    return text.lower().translate(_LETTERS).split()


def postings(documents: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, length, terms, counts`` of every text that has a term, for the terms of a block of queries; written once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.get
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                words = terms_of(text.as_py() or b"")
                if words:
                    found, counts = np.unique(np.array([place for place in map(known, words) if place is not None], np.int32), return_counts=True)
                    rows.append((doc_id, len(words), found, counts.astype(np.int32)))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "length", "terms", "counts"])

    return written(documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(count, _INDEX), "search-index")


class Shard:
    """Posting lists of some texts, with a sparse table of greatest impacts over each list."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray,
                 weights: np.ndarray, texts: int, total: int):
        order = np.lexsort((ids, lengths))
        self.ids, self.texts = ids[order], len(ids)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        text = np.repeat(rank, sizes)
        places = np.lexsort((text, terms))
        self.text, term, count = text[places], terms[places].astype(np.int64), counts[places].astype(np.int64)
        norm = 25 + 75 * lengths[order] * texts // total
        self.keys = term * (self.texts + 1) + self.text
        self.impact = weights[term] * (1_000_000_000 * count // (1000 * count + 8 * norm[self.text]))
        holders = np.bincount(term, minlength=len(weights))
        self.ends = np.cumsum(holders)  # of each term's list
        self.begins = self.ends - holders
        # Level k holds, for each posting, the place of the greatest impact among it and the 2^k - 1 after it.
        size, number = len(self.impact), int(holders.max(initial=1)).bit_length()
        self.where = np.zeros((number, size), np.int32)
        self.where[0] = np.arange(size)
        for level in range(1, number):
            step = 1 << level - 1
            before, self.where[level] = self.where[level - 1], self.where[level - 1]
            after = before[step:]
            self.where[level, :-step] = np.where(self.impact[after] > self.impact[before[:-step]], after, before[:-step])
        self.flat = self.where.ravel()
        self.log = np.frexp(np.maximum(np.arange(int(holders.max(initial=1)) + 1), 1))[1].astype(np.int64) - 1  # floor of log2

    def maxima(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greatest impact and its place in each stretch of postings: two overlapping table entries; impact 0 of an empty stretch."""
        level = self.log[last - first]
        row = level * len(self.impact)
        left = self.flat[row + np.minimum(first, len(self.impact) - 1)]
        right = self.flat[row + np.maximum(last - (1 << level), 0)]
        best, other = self.impact[left], self.impact[right]
        return np.where(last > first, np.maximum(best, other), 0), np.where(other > best, right, left)


def better(scores: np.ndarray, ids: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``top`` by score, ties to the smaller id."""
    order = np.lexsort((ids, -scores))[:top]
    return scores[order], ids[order]


def search(shard: Shard, terms: np.ndarray, repeats: np.ndarray, top: int, scores: np.ndarray, ids: np.ndarray,
           opened: int = OPENED, short: int = SHORT) -> tuple[np.ndarray, np.ndarray]:
    """The best texts of one query: those kept so far (``scores``, ``ids``) and those of the shard.

    A range is a stretch of texts (``low`` to ``high``) and, for each term, a stretch of its list (``first`` to ``last``).
    """
    here = shard.begins[terms] < shard.ends[terms]
    terms, repeats = terms[here], repeats[here]
    if not len(terms):
        return scores, ids
    base = terms * (shard.texts + 1)

    def ranges(low: np.ndarray, high: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        best, where = shard.maxima(first, last)
        best *= repeats
        split = shard.text[np.take_along_axis(where, best.argmax(axis=1)[:, None], axis=1)[:, 0]]
        return [low, high, first, last, best.sum(axis=1), split]

    waiting = ranges(np.zeros(1, np.int64), np.full(1, shard.texts, np.int64), shard.begins[terms][None, :], shard.ends[terms][None, :])
    while True:
        # A range whose bound equals the worst kept score may hold a smaller id: only lower bounds are done with.
        bounds = waiting[4]
        able = np.flatnonzero(bounds >= (scores[-1] if len(scores) == top else 1))
        if not len(able):
            return scores, ids
        chosen = able if len(able) <= opened else able[np.argpartition(-bounds[able], opened)[:opened]]
        low, high, first, last, _, split = [column[chosen] for column in waiting]
        rest = np.zeros(len(bounds), bool)
        rest[able] = True
        rest[chosen] = False
        small = high - low <= short
        texts, found = whole_scores(shard, first[small], last[small], repeats)
        low, high, first, last, split = [column[~small] for column in (low, high, first, last, split)]
        wanted = base + split[:, None]
        place = np.searchsorted(shard.keys, wanted)
        hit = shard.keys[np.minimum(place, len(shard.keys) - 1)] == wanted
        own = (np.where(hit, shard.impact[np.minimum(place, len(shard.keys) - 1)], 0) * repeats).sum(axis=1)
        texts, found = np.concatenate([texts, split]), np.concatenate([found, own])
        reaching = found >= (scores[-1] if len(scores) == top else 1)
        scores, ids = better(np.concatenate([scores, found[reaching]]), np.concatenate([ids, shard.ids[texts[reaching]]]), top)
        parts = ranges(np.concatenate([low, split + 1]), np.concatenate([split, high]),
                       np.concatenate([first, place + hit]), np.concatenate([place, last])) if len(low) else [column[:0] for column in waiting]
        waiting = [np.concatenate([column[rest], part]) for column, part in zip(waiting, parts, strict=True)]


def whole_scores(shard: Shard, first: np.ndarray, last: np.ndarray, repeats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a posting in some ranges, and their exact scores."""
    sizes = (last - first).ravel()
    places = np.repeat(first.ravel() - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
    texts, member = np.unique(shard.text[places], return_inverse=True)
    found = np.zeros(len(texts), np.int64)
    np.add.at(found, member, shard.impact[places] * np.repeat(np.broadcast_to(repeats, first.shape).ravel(), sizes))
    return texts, found


def found_in(index: DataFrame, queries: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, texts: int, total: int, top: int,
             shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """``query, doc_id, score``: the best texts of each query in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {number: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for number, _, _ in queries}

        def visit(columns: list[pa.Array]) -> None:
            ids, lengths, terms, counts = columns
            sizes = np.diff(terms.offsets.to_numpy())
            shard = Shard(ids.fill_null(NO_ID).to_numpy(zero_copy_only=False), lengths.to_numpy(), sizes, terms.flatten().to_numpy(),
                          counts.flatten().to_numpy(), weights, texts, total)
            if len(shard.keys):
                for number, asked, repeats in queries:
                    kept[number] = search(shard, asked, repeats, top, *kept[number])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            while len(batch):
                room = shard_texts - sum(map(len, held))
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(map(len, held)) == shard_texts:
                    visit([column.combine_chunks() for column in pa.Table.from_batches(held).columns])
                    held.clear()
        if held:
            visit([column.combine_chunks() for column in pa.Table.from_batches(held).columns])
        rows = [(number, found_id, score) for number, (scores, ids) in kept.items() for score, found_id in zip(scores.tolist(), ids.tolist(), strict=True)]
        numbers, found_ids, scores = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array([None if one == NO_ID else one for one in found_ids], pa.int64()),
                                          pa.array(scores, pa.int64())], names=["query", "doc_id", "score"])

    return index.mapInArrow(run, "query long, doc_id long, score long")


def ranked(documents: DataFrame, items: DataFrame, top: int = TOP, block_items: int = BLOCK_ITEMS, shard_texts: int = SHARD_TEXTS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best texts of every item."""
    spark = documents.sparkSession
    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    own = F.when(F.col("item_id").isNull(), F.col("text")).alias("own")
    grouped = written(texts.groupBy("item_id", own).agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).withColumn(
        "query", F.monotonically_increasing_id()), "queries")
    blocks = max(1, -(-grouped.count() // block_items))
    results = []
    for block in range(blocks):
        rows = grouped.filter(F.pmod(F.xxhash64("query"), F.lit(blocks)) == block).select("query", "text").collect()  # a block of queries
        asked = {row["query"]: terms_of(row["text"].encode()) for row in rows}
        vocabulary = {term: place for place, term in enumerate(sorted({term for terms in asked.values() for term in terms}))}
        index = postings(documents, vocabulary)
        size = index.agg(F.count("*").alias("texts"), F.sum("length").alias("total")).first()
        holders = np.zeros(len(vocabulary), np.int64)
        for row in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the block
            holders[row["term"]] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * size.texts + 2) / (2 * count + 1))) for count in holders.tolist()], np.int64)
        queries = [(number, *np.unique(np.array([vocabulary[term] for term in terms], np.int64), return_counts=True))
                   for number, terms in asked.items() if terms]
        if size.texts and queries:
            results.append(found_in(index, queries, weights, size.texts, size.total, top, shard_texts))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long").withColumn("item_id", F.col("item_id").cast(items.schema["item_id"].dataType))
    found = results[0]
    for other in results[1:]:
        found = found.union(other)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    first = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return first.join(grouped.select("query", "item_id"), "query").select("item_id", "rank", "doc_id", "score")

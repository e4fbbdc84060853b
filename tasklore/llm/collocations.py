"""Operator 11, phrase collocations by dynamic itemset counting.

The encoded corpus lies in a few shards that are scanned in a cycle, one Spark job a shard. All lengths are counted in the same scans:
words from the first scan on, a longer phrase from the scan after the one in which both of its subphrases (all words but the last, all
but the first) have reached the threshold, and each until it has seen every shard once. When no phrase has become frequent for a
whole cycle, every count is complete.

A phrase is active where it occurs: a position is counted if the subphrases there are in the filter of frequent phrases. That filter is
a bit array of fixed size, however many phrases there are; what it lets through wrongly is counted in vain and cannot become frequent,
because a phrase is never more frequent than its parts. A second filter holds what became frequent within the last cycle, so
complete phrases are not counted again; if one is, the count of that shard is the same and is taken once. Phrases travel as 64-bit hashes;
the last scan reads the parts of the frequent ones, and two phrases with one hash lead to a run with another seed.

Defined results: null text is empty, null lang is ``und``; repeated rows and ids count each; an empty table gives no rows;
only ``text`` and ``lang`` are read. A long text is held once a task; counts are pre-aggregated in the scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklore.llm.common import written
from tasklore.operators.sizing import MAX_BROADCAST_BYTES, join_measured
from tasklore.session import scratch_path

MIN_COUNT, MAX_WORDS, TOP = 100, 5, 2000
SHARDS = 2
FILTER_BITS = 1 << 22  # 512 KB; more bits prune more on larger corpora, the result is the same
HELD_WORDS = 1 << 17
HELD_ROWS = 1 << 20
BREAK = 0  # between pieces in an encoded text
SEEDS = range(8)

_BREAKS = b".,;:!?\n\x0b\x0c\r"
_FLAT = bytes.maketrans(_BREAKS + b"\t", b"\n" * len(_BREAKS) + b" ")
_ENCODED = "shard int, lang string, tokens binary, words array<string>, hashes array<long>, counts array<long>"
_SPREAD, _FOLD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """Hash of each word met, made once; never ``BREAK``."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed
        self[b"\n"] = BREAK

    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word, self.seed) or 1
        return value


def tokens(text: bytes) -> list[bytes]:
    """Words of a text in order, with a line feed wherever a piece ends."""
    return [word for word in text.lower().translate(_FLAT).replace(b"\n", b" \n ").split(b" ") if word]


def encode(documents: DataFrame, shards: int, seed: int, held_words: int = HELD_WORDS) -> DataFrame:
    """The corpus as word hashes by shard and lang, with the words of each block and their counts; written once."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()  # each language's blocks go round the shards
        held: dict[str, tuple[WordHashes, list[np.ndarray]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal turn, size
            rows = []
            for number, (lang, (hashes, parts)) in enumerate(held.items(), turn):
                block = np.concatenate(parts)
                del hashes[b"\n"]
                found, counts = np.unique(block, return_counts=True)
                names, values = list(hashes), np.array(list(hashes.values()), np.uint64)
                rows.append((number % shards, lang, block.tobytes(), [name.decode("utf-8", "replace") for name in names],
                             values.view(np.int64).tolist(), counts[np.searchsorted(found, values)].tolist()))
            held.clear()
            turn, size = turn + 1, 0
            kinds = (pa.int32(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)],
                                              names=["shard", "lang", "tokens", "words", "hashes", "counts"])

        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lang, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                if lang not in held:
                    held[lang] = (WordHashes(xxhash.xxh64_intdigest(lang, seed)), [])
                hashes, parts = held[lang]
                words = tokens(text.as_py())
                parts.append(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)))
                parts.append(np.array([BREAK], np.uint64))
                size += len(words) + 1
                if size >= held_words:
                    yield flush()
        if held:
            yield flush()

    rows = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    path = scratch_path(documents.sparkSession, "encoded")
    rows.mapInArrow(blocks, _ENCODED).write.partitionBy("shard").parquet(path)
    return documents.sparkSession.read.schema(_ENCODED).parquet(path)


def contains(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter: two places of each."""
    last = np.uint64(64 * len(bits) - 1)
    found = np.ones(len(hashes), bool)
    for place in (hashes & last, hashes >> np.uint64(32) & last):
        found &= (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def filter_of(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bit array of a table of hashes; at most ``bits / 64`` numbers reach the driver."""
    places = F.array(F.col("hash").bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(bits - 1)))
    placed = hashes.select(F.explode(places).alias("place")).select(
        F.shiftright("place", 6).alias("cell"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    rows = placed.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[rows.column("cell").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def occurrences(block: np.ndarray, frequent: np.ndarray, recent: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(words, hash, prefix hash, suffix hash) of the phrases that are active in a block, by length."""
    place = np.flatnonzero((block != BREAK) & contains(frequent, block))
    hashes = block[place]
    fresh = contains(recent, hashes)
    for words in range(2, longest + 1):
        both = np.flatnonzero(place[1:] == place[:-1] + 1)
        place, prefix, suffix, fresh = place[both], hashes[both], hashes[both + 1], fresh[both] | fresh[both + 1]
        hashes = prefix * _SPREAD + block[place + words - 1]
        hashes ^= hashes >> np.uint64(29)
        hashes *= _FOLD
        hashes ^= hashes >> np.uint64(32)
        yield words, hashes[fresh], prefix[fresh], suffix[fresh]
        if words < longest:
            known = contains(frequent, hashes)
            place, hashes = place[known], hashes[known]
            fresh = contains(recent, hashes)


def scan(blocks: DataFrame, frequent: np.ndarray, recent: np.ndarray, longest: int) -> DataFrame:
    """``hash, n``: occurrences of active phrases in the blocks, partly summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

        for batch in batches:
            for block in batch.column(0):
                held.extend(found[1] for found in occurrences(np.frombuffer(block.as_py(), np.uint64), frequent, recent, longest))
                if sum(map(len, held)) >= HELD_ROWS:
                    yield flush()
        if held:
            yield flush()

    return blocks.select("tokens").mapInArrow(count, "hash long, n long")


def parts(blocks: DataFrame, frequent: np.ndarray, longest: int) -> DataFrame:
    """``hash, words, prefix, suffix`` of the phrases that the filter lets through, each once a task batch."""

    def define(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0):
                for words, hashes, prefix, suffix in occurrences(np.frombuffer(block.as_py(), np.uint64), frequent, frequent, longest):
                    known = contains(frequent, hashes)
                    found = np.unique(np.stack([hashes[known], prefix[known], suffix[known]]), axis=1).view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[0]), pa.array(np.full(found.shape[1], words, np.int32)), pa.array(found[1]), pa.array(found[2])],
                        names=["hash", "words", "prefix", "suffix"])

    return blocks.select("tokens").mapInArrow(define, "hash long, words int, prefix long, suffix long")


def _sums(tables: list[DataFrame], min_count: int, shards: int, repeated: bool) -> DataFrame:
    """``hash, f`` of what reaches the threshold in shard tables. It must hold a fair share of it in one shard, so few rows are shuffled.

    ``repeated``: several tables may be of one shard, and a count in both is taken once.
    """
    rows = tables[0]
    for other in tables[1:]:
        rows = rows.union(other)
    strong = rows.filter(F.col("n") >= -(-min_count // shards)).select("hash")
    small = 16 * strong.count() <= MAX_BROADCAST_BYTES
    rows = rows.join(F.broadcast(strong) if small else strong, "hash", "left_semi")
    if repeated:
        rows = rows.groupBy("hash", "shard").agg(F.max("n").alias("n"))
    return rows.groupBy("hash").agg(F.sum("n").alias("f")).filter(F.col("f") >= min_count)


def frequent_phrases(encoded: DataFrame, min_count: int, longest: int, shards: int, bits: int) -> DataFrame:
    """``hash, f`` of all phrases of up to ``longest`` words that reach the threshold, by cyclic scans."""
    tables: list[DataFrame] = []
    reached: DataFrame | None = None
    frequent = np.zeros(bits // 64, np.uint64)
    cycle: list[np.ndarray] = []  # filters of what became frequent in each of the last scans
    step = 0
    while step < shards or any(bit_array.any() for bit_array in cycle):
        shard = step % shards
        blocks = encoded.filter(F.col("shard") == shard)
        recent = np.bitwise_or.reduce(cycle) if cycle else frequent
        counted = scan(blocks, frequent, recent, longest) if step else None
        if step < shards:
            words = blocks.select(F.explode(F.arrays_zip("hashes", "counts")).alias("word")).select(
                F.col("word.hashes").alias("hash"), F.col("word.counts").alias("n"))
            counted = counted.union(words) if step else words
        counted = counted.groupBy("hash").agg(F.sum("n").alias("n")).withColumn("shard", F.lit(shard))
        tables.append(written(counted, "shard-counts"))
        now = _sums(tables[-shards:], min_count, shards, False).select("hash")
        new = written(now if reached is None else now.join(reached, "hash", "left_anti"), "reached")
        reached = new if reached is None else written(reached.union(new), "all-reached")
        cycle = [*cycle, filter_of(new, bits)][-shards:]
        frequent = frequent | cycle[-1]
        step += 1
    return written(_sums(tables, min_count, shards, True), "frequent")


def _levels(definitions: DataFrame, words: DataFrame, frequent: DataFrame, longest: int) -> list[DataFrame]:
    """Frequent phrases by length: ``hash, lang, phrase`` (array), counts of their first parts ``heads`` and last parts ``tails``."""
    levels = [written(words.join(frequent, "hash").select(
        "hash", "lang", "f", F.array("word").alias("phrase"),
        F.array().cast("array<long>").alias("heads"), F.array().cast("array<long>").alias("tails")), "phrases-1")]
    known = definitions.join(frequent, "hash")
    for length in range(2, longest + 1):
        shorter = levels[-1]
        first = shorter.select(F.col("hash").alias("prefix"), "lang", F.col("phrase").alias("first_words"), F.col("f").alias("first_f"), "heads")
        rest = shorter.select(F.col("hash").alias("suffix"), F.element_at("phrase", -1).alias("last_word"), F.col("f").alias("rest_f"), "tails")
        levels.append(written(known.filter(F.col("words") == length).join(first, "prefix").join(rest, "suffix").select(
            "hash", "lang", "f", F.concat("first_words", F.array("last_word")).alias("phrase"),
            F.concat("heads", F.array("first_f")).alias("heads"), F.concat("tails", F.array("rest_f")).alias("tails"), "prefix", "suffix"), f"phrases-{length}"))
    return levels


def scored(levels: list[DataFrame], sizes: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of the candidates that no longer phrase of the same count holds.

    It is enough to look one word further: counts never grow with a phrase, so if a much longer one is as frequent, so is one in between.
    Products are decimals of 38 digits: counts below 10^17 are exact.
    """
    rows = []
    for number, level in enumerate(levels[1:], 1):
        if number + 1 < len(levels):
            longer = levels[number + 1].select(F.explode(F.array("prefix", "suffix")).alias("hash"), F.col("f").alias("longer_f")).groupBy(
                "hash").agg(F.max("longer_f").alias("longer_f"))
            level = level.join(longer, "hash", "left").filter("longer_f is null or longer_f < f")
        rows.append(level.select("lang", "phrase", "f", "heads", "tails"))
    together = rows[0]
    for other in rows[1:]:
        together = together.union(other)
    cut = """array_min(transform(sequence(1, size(heads)), k -> named_struct(
        'score', (1000 * cast(f as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(heads[k - 1] as decimal(19,0)) * cast(tails[size(tails) - k] as decimal(19,0))),
        'k', k, 'l', heads[k - 1], 'r', tails[size(tails) - k])))"""
    found = together.join(sizes, "lang").withColumn("cut", F.expr(cut))
    return found.select("lang", F.concat_ws(" ", "phrase").alias("phrase"), F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def collocations(documents: DataFrame, min_count: int = MIN_COUNT, longest: int = MAX_WORDS, top: int = TOP, shards: int = SHARDS,
                 bits: int = FILTER_BITS, held_words: int = HELD_WORDS) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its parts at the weakest cut, ``n`` the words of the language.
    """
    if longest < 2 or shards < 1 or bits & (bits - 1) or bits < 64:
        raise ValueError("phrases have two words at least; the filter's bits are a power of two")
    for seed in SEEDS:
        encoded = encode(documents, shards, seed, held_words)
        frequent = frequent_phrases(encoded, min_count, longest, shards, bits)
        vocabulary = encoded.select("lang", F.explode(F.arrays_zip("words", "hashes", "counts")).alias("word")).select(
            "lang", F.col("word.words").alias("word"), F.col("word.hashes").alias("hash"), F.col("word.counts").alias("n"))
        vocabulary = written(vocabulary.groupBy("lang", "word", "hash").agg(F.sum("n").alias("n")), "vocabulary")
        definitions = written(join_measured(parts(encoded, filter_of(frequent.select("hash"), bits), longest), frequent.select("hash"), ["hash"], "known").distinct(), "parts")
        owners = vocabulary.select("hash").union(definitions.select("hash")).join(frequent, "hash")
        if owners.groupBy("hash").count().filter("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("two phrases share a hash under every seed")
    levels = _levels(definitions, vocabulary.drop("n"), frequent, longest)
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored(levels, vocabulary.groupBy("lang").agg(F.sum("n").alias("n"))).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

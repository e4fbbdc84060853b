"""Operator 2, best-fit packing of tokenized documents into sequences of bounded length.

Best-fit decreasing with a segment tree over remaining capacities. Lengths are whole numbers up to the sequence length, so the packing
is planned on the count of pieces of each length, which does not grow with the table: the tree finds the tightest remaining
capacity with an open sequence in logarithmic time, and sequences with the same history are handled as one range.
The plan is exactly that of placing the pieces one by one, longest first. Executors then number the pieces of
each length and look their places up.

Defined results: a null or empty text is the single end token; rows that repeat an id are packed each; ids may be
null; an empty table gives no rows. Special-token strings in a text are read as the tokenizer file says.
"""

from __future__ import annotations

import re
import weakref
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklore.llm.common import give_back, strings, texts_for_python, written

MAX_TOKENS = 2048
END_ID = 0
END = END_ID.to_bytes(4, "little")
KNOWN_ENTRIES = 200_000
SLICE_CHARACTERS = 4_000_000
MARKS = frozenset(".,;:!?")
SHARD_ROWS = 50_000
RUNS_BROADCAST = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def byte_alphabet() -> dict[int, str]:
    """The characters that byte-level BPE writes for bytes: printable ones stand for themselves, the others come after 255 in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [byte for byte in range(256) if byte not in printable]
    return {byte: chr(byte) if byte in printable else chr(256 + others.index(byte)) for byte in range(256)}


class KnownIds:
    """Ids of texts made once a text, held as Arrow arrays of a few bytes an entry. Beyond ``entries`` only those just asked for stay."""

    def __init__(self, make: Callable[[list[str]], pa.Array], entries: int):
        self.make, self.entries = make, entries
        self.keys, self.ids = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def of(self, texts: pa.Array) -> pa.Array:
        asked = texts.dictionary_encode()
        places = pc.index_in(asked.dictionary, value_set=self.keys)
        if places.null_count:
            new = places.is_null().to_numpy(zero_copy_only=False)
            keys = asked.dictionary.filter(pa.array(new))
            known = places.fill_null(0).to_numpy().copy()
            known[new] = np.arange(len(self.keys), len(self.keys) + len(keys))
            places = pa.array(known)
            self.ids = pa.concat_arrays([self.ids, self.make(keys.to_pylist())])
            self.keys = pa.concat_arrays([self.keys, keys])
        found = self.ids.take(places.take(asked.indices))
        if len(self.keys) > self.entries:
            self.keys, self.ids = asked.dictionary, self.ids.take(places)
        return found


def joined(ids: pa.Array, starts: np.ndarray) -> pa.Array:
    """Neighbouring entries put together: those from one start up to the next."""
    if not len(ids):
        return pa.array([b""] * (len(starts) - 1), pa.large_binary())
    _, places, content = ids.buffers()
    return pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(np.frombuffer(places, np.int64)[starts]), content])


class DocumentIds:
    """Token ids of whole texts. The tokenizer's model encodes each pre-token on its own, so repeated ones are looked up.

    Only texts of common Latin characters, without digits that are no ASCII digits, are split here: for those every library agrees on
    letters, numbers and white space. All others, and texts that hold a special token, go to the tokenizer whole. A pre-token has no
    space but at its start, so a text whose spaces are single is taken in chunks from space to space; Arrow splits the texts of a slice and
    finds their different chunks, and Python sees each of those once a slice.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()
        self.space = self.alphabet[32]
        # The pre-token pattern of the vocabulary, for the characters that ``uncommon`` lets pass.
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall
        self.special = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.uncommon = re.compile("[^\t\n\r -~¡-±´-¸º»¿-ɏ]")
        me = weakref.proxy(self)  # without a cycle the entries go when their task ends, not when a Python worker happens to collect garbage
        self.words = KnownIds(lambda words: me._of_words(words), KNOWN_ENTRIES)
        self.chunks = KnownIds(lambda chunks: me._of_chunks(chunks), KNOWN_ENTRIES)

    def _word(self, word: str) -> bytes:
        if word[:1] == " " and word.isascii() and word[1:].isalpha():
            spelt = self.space + word[1:]
        else:
            spelt = word.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([token.id.to_bytes(4, "little") for token in self.model.tokenize(spelt)])

    def _of_words(self, words: list[str]) -> pa.Array:
        return pa.array(map(self._word, words), pa.large_binary())

    def _of_chunks(self, chunks: list[str]) -> pa.Array:
        """What follows a space. A word, or a word and one mark, needs no pattern: a run of letters is one pre-token, and so is a mark after it."""
        def words(chunk: str) -> list[str]:
            if chunk.isalpha():
                return [" " + chunk]
            if chunk[-1:] in MARKS and chunk[:-1].isalpha():
                return [" " + chunk[:-1], chunk[-1]]
            return self.split(" " + chunk)

        return self._joined(map(words, chunks))

    def _joined(self, lists: Iterable[list[str]]) -> pa.Array:
        """Ids of lists of pre-tokens."""
        flat, starts = [], [0]
        for words in lists:
            flat += words
            starts.append(len(flat))
        return joined(self.words.of(pa.array(flat, pa.large_string())), np.array(starts))

    def of(self, text: str | None) -> bytes:
        return self.of_all([text])[0]

    def of_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with its end token."""
        found = [END] * len(texts)
        split: list[int] = []
        firsts, others = [], []  # a text up to its first space, or all of it, and the rest
        for number, text in enumerate(texts):
            if not text:
                continue
            if self.uncommon.search(text) or any(token in text for token in self.special):
                found[number] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes() + END
                continue
            first, space, rest = (text, "", "") if "  " in text else text.partition(" ")
            split.append(number)
            firsts.append(first)
            others.append(rest if space else None)
        chunks = pc.split_pattern(pa.array(others, pa.large_string()), " ")
        heads = self._joined(map(self.split, firsts))
        tails = joined(self.chunks.of(chunks.flatten()), np.asarray(chunks.offsets))
        for number, head, tail in zip(split, heads, tails, strict=True):
            found[number] = b"".join([head.as_buffer(), tail.as_buffer(), END])
        return found


def slices(texts: list[str | None], characters: int) -> Iterator[slice]:
    """Neighbouring texts of about so many characters; a longer one stands alone."""
    start = held = 0
    for number, text in enumerate(texts):
        size = len(text or "")
        if held and held + size > characters:
            yield slice(start, number)
            start, held = number, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))


def cut(size: int, limit: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document: full ones, after a first one that holds what is left over."""
    first = size % limit or limit
    return [(0, min(first, size))] + [(start, limit) for start in range(first, size, limit)]


def pieces(documents: DataFrame, tokenizer: str, limit: int = MAX_TOKENS) -> DataFrame:
    """Tokenize whole texts and cut them; one row per piece, without the ids."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = None
        for batch in batches:
            ids_of = ids_of or DocumentIds(tokenizer)
            rows: list[tuple] = []
            doc_ids, texts = strings(batch, "doc_id"), strings(batch, "text")
            for part in slices(texts, SLICE_CHARACTERS):
                for doc_id, ids in zip(doc_ids[part], ids_of.of_all(texts[part]), strict=True):
                    rows += [(doc_id, number, start, length, zlib.crc32(ids[4 * start:4 * (start + length)]))
                             for number, (start, length) in enumerate(cut(len(ids) // 4, limit))]
                give_back()
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])
        ids_of = None  # the known ids go before Arrow's memory is given back for good
        give_back()

    return texts_for_python(documents.select("doc_id", "text")).mapInArrow(compute, PIECES)


class CapacityTree:
    """Segment tree over remaining capacities: is a sequence with this much room open, and which is the tightest that fits?"""

    def __init__(self, limit: int):
        self.size = 1 << limit.bit_length()
        self.open = [0] * (2 * self.size)

    def add(self, capacity: int, sequences: int) -> None:
        node = self.size + capacity
        while node:
            self.open[node] += sequences
            node //= 2

    def tightest(self, needed: int) -> int | None:
        """The smallest capacity of at least ``needed`` with an open sequence."""
        node = self.size + needed
        if self.open[node]:
            return needed
        while node > 1:
            if node % 2 == 0 and self.open[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.open[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


@dataclass(frozen=True)
class Run:
    """Pieces of one length with ranks from ``first`` to ``last`` (exclusive): ``each`` to a sequence, from ``sequence`` on."""

    length: int
    first: int
    last: int
    sequence: int
    each: int
    offset: int


def plan(counts: dict[int, int], limit: int = MAX_TOKENS) -> list[Run]:
    """Best-fit decreasing for so many pieces of each length.

    A sequence that has taken a piece has less room than before; if another such piece still fits, it is again the
    tightest. So it takes all that fit, and ranges of like sequences are filled at once.
    """
    tree = CapacityTree(limit)
    stacks: dict[int, list[tuple[int, int]]] = defaultdict(list)  # capacity: (first sequence, sequences)
    runs, sequences = [], 0

    def put(capacity: int, first: int, number: int) -> None:
        if number and capacity:
            tree.add(capacity, number)
            stacks[capacity].append((first, number))

    for length in sorted((length for length, count in counts.items() if count), reverse=True):
        done, count = 0, counts[length]
        while done < count:
            capacity = tree.tightest(length)
            each = (capacity or limit) // length
            if capacity is None:
                capacity = limit
                first, number = sequences, -(-(count - done) // each)
                sequences += number
            else:
                first, number = stacks[capacity].pop()
                tree.add(capacity, -number)
            full = min(number, (count - done) // each)
            if full:
                runs.append(Run(length, done, done + full * each, first, each, limit - capacity))
                put(capacity - each * length, first, full)
                done += full * each
            rest = count - done if full < number else 0
            if rest:
                runs.append(Run(length, done, count, first + full, rest, limit - capacity))
                put(capacity - rest * length, first + full, 1)
                done = count
            put(capacity, first + full + bool(rest), number - full - bool(rest))
    return runs


def pack(documents: DataFrame, tokenizer: str, limit: int = MAX_TOKENS) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece.

    Ranks inside a length are exact without one task per length: pieces are dealt to shards of about ``SHARD_ROWS`` by hash, ranked inside
    (shard, length), and moved by the counts of that length in earlier shards.
    """
    spark = documents.sparkSession
    found = written(pieces(documents, tokenizer, limit), "pieces")
    shards = max(64, -(-found.count() // SHARD_ROWS))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)))
    counts = written(dealt.groupBy("shard", "length").agg(F.count("*").alias("n")), "length-counts")
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # at most one row per length up to the limit
    runs = plan({row.length: row.n for row in totals}, limit)
    earlier = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    skipped = counts.select("shard", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("skipped"))
    inside = Window.partitionBy("shard", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("rank_inside", F.row_number().over(inside) - 1).join(skipped, ["shard", "length"]).withColumn(
        "rank", F.col("skipped") + F.col("rank_inside"))
    places = spark.createDataFrame(
        [(run.length, run.first, run.last, run.sequence, run.each, run.offset) for run in runs],
        "run_length long, first_rank long, last_rank long, first_sequence long, each long, first_offset long")
    if len(runs) <= RUNS_BROADCAST:  # a few thousand in practice; the plan depends on lengths, not on the number of rows
        places = F.broadcast(places)
    here = (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("last_rank"))
    return ranked.join(places, here).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor((F.col("rank") - F.col("first_rank")) / F.col("each"))).alias("sequence_id"),
        (F.col("first_offset") + (F.col("rank") - F.col("first_rank")) % F.col("each") * F.col("length")).alias("offset"))


def pack_bpe(documents: DataFrame) -> DataFrame:
    """The contract of op2 and the last pipeline stage: byte-level BPE of the public tokenizers, 2048 tokens."""
    import public_tokenizers

    return pack(documents, public_tokenizers.path("byte_bpe_50k.json"))

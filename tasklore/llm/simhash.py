"""Operator 8, near-duplicates by SimHash fingerprints.

Fingerprints are compared exactly, tile against tile, with numpy exclusive-or and bit counts; rows of a tile are sorted by
population count, and what lies further apart than the radius is skipped. Tiles hold fingerprints that agree in one of ``radius + 1``
bit bands: two fingerprints with at most ``radius`` differing bits agree in at least one, so no link is lost, while comparing every
tile of a table with every other would grow with its square. A band value with more rows than a tile is split by
population count and salt, and only pairs of such tiles within the radius are formed.

Defined results: a null, empty or blank text has fingerprint zero and links like any other; a null id is fingerprinted
but does not name a component (its component is null only if no row of the component has an id); repeated rows share a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklore.llm.common import give_back, packed, strings, texts_for_python, unpacked, written
from tasklore.llm.components import components, merge
from tasklore.operators.sizing import measured

SHINGLE_WORDS = 3
SEED = 42
TILE_ROWS = 4096
BUFFER_ROWS = 65_536
SALTS = 16


def fingerprint(text: str | None) -> int:
    """Majority bits of the hashes of all word shingles of a whole text, as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    if len(words) <= SHINGLE_WORDS:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        starts = [0, *(ends[:-SHINGLE_WORDS] + 1).tolist()]
        hashes = [xxhash.xxh64_intdigest(joined[start:end], SEED)
                  for start, end in zip(starts, ends[SHINGLE_WORDS - 1:].tolist(), strict=True)]
    values = np.array(hashes, np.uint64).view(np.uint8)
    totals = np.zeros(64, np.int64)
    for begin in range(0, len(values), 8 * 65_536):  # bounded memory for very long texts
        totals += np.unpackbits(values[begin:begin + 8 * 65_536].reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * totals > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``fingerprint_bits`` (signed long) of every document."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text) for text in strings(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fingerprint_bits"])
            give_back()

    return texts_for_python(documents.select("doc_id", "text")).mapInArrow(compute, "doc_id long, fingerprint_bits long")


def _bands(distinct: DataFrame, radius: int) -> DataFrame:
    """One row per fingerprint and band: the band's bits in place, all others zero."""
    width = -(-64 // (radius + 1))
    parts = []
    for number in range(radius + 1):
        mask = ((1 << width) - 1) << number * width & (1 << 64) - 1
        signed = mask - (1 << 64) if mask >> 63 else mask
        parts.append(F.struct(F.lit(number).alias("band"), F.col("fingerprint_bits").bitwiseAND(F.lit(signed)).alias("band_bits")))
    return distinct.select("fingerprint_bits", F.bit_count("fingerprint_bits").alias("ones"), F.inline(F.array(*parts)))


def tiles(distinct: DataFrame, radius: int, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Rows dealt to tiles and tile pairs: ``tile`` (hash of its key), ``side`` (0 first, 1 second, 2 alone), ``ones``, bits.

    A band value of up to ``tile_rows`` rows is one tile. Larger ones are split by population count and by salt; two tiles meet only if
    their population counts differ by ``radius`` at most.
    """
    rows = _bands(distinct, radius)
    keys = ["band", "band_bits"]
    crowded = written(rows.groupBy(*keys, "ones").agg(F.count("*").alias("n")).withColumn(
        "total", F.sum("n").over(Window.partitionBy(*keys))).filter(F.col("total") > tile_rows).drop("total"), "crowded")
    alone = rows.join(crowded.select(*keys).distinct(), keys, "left_anti").select(
        F.xxhash64(*keys).alias("tile"), *keys, F.lit(2).alias("side"), "ones", "fingerprint_bits")
    split = crowded.withColumn("salts", F.ceil(F.col("n") / tile_rows).cast("int"))
    parts = split.select(*keys, "ones", "salts", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    first, second = parts.select(*keys, F.col("ones").alias("ones_a"), F.col("salt").alias("salt_a")), parts.select(
        *keys, F.col("ones").alias("ones_b"), F.col("salt").alias("salt_b"))
    near = (F.col("ones_b") >= F.col("ones_a")) & (F.col("ones_b") - F.col("ones_a") <= radius)
    ordered = near & ((F.col("ones_b") > F.col("ones_a")) | (F.col("salt_b") >= F.col("salt_a")))
    pairs = first.join(second, keys).filter(ordered)
    pairs = written(pairs.withColumn("tile", F.xxhash64(*keys, "ones_a", "salt_a", "ones_b", "salt_b")), "tile-pairs")
    salted = rows.join(split.select(*keys, "ones", "salts"), [*keys, "ones"]).withColumn(
        "salt", F.pmod(F.xxhash64("fingerprint_bits"), F.col("salts")).cast("int")).drop("salts")
    itself = (F.col("ones_a") == F.col("ones_b")) & (F.col("salt_a") == F.col("salt_b"))
    ends = pairs.select("tile", *keys, F.col("ones_a").alias("ones"), F.col("salt_a").alias("salt"), F.when(itself, 2).otherwise(0).alias("side")).union(
        pairs.filter(~itself).select("tile", *keys, F.col("ones_b"), F.col("salt_b"), F.lit(1)))
    met = salted.join(ends, [*keys, "ones", "salt"]).select("tile", *keys, "side", "ones", "fingerprint_bits")
    return alone.union(met)


def compare(tile: np.ndarray, side: np.ndarray, ones: np.ndarray, bits: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside each tile of rows sorted by (tile, ones), as a forest: (member position, root position)."""
    parents = np.arange(len(bits))
    active = np.arange(len(bits) - 1)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0
    for shift in range(1, len(bits)):
        active = active[active + shift < len(bits)]
        # Rows of a tile are sorted by population count: once a neighbour is too far, all later ones are.
        active = active[(tile[active] == tile[active + shift]) & (ones[active + shift] - ones[active] <= radius)]
        if not len(active):
            break
        other = active + shift
        near = np.bitwise_count(bits[active] ^ bits[other]) <= radius
        near &= (side[active] != side[other]) | (side[active] == 2)
        if near.any():
            found.append((active[near], other[near]))
            held += int(near.sum())
            if held > 1_000_000:
                merge(parents, *map(np.concatenate, zip(*found, strict=True)))
                found, held = [], 0
    if found:
        merge(parents, *map(np.concatenate, zip(*found, strict=True)))
    members = np.flatnonzero(parents != np.arange(len(bits)))
    return members, parents[members]


def links(distinct: DataFrame, radius: int = 3, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links ``(left_node, right_node)`` that join all fingerprints within the radius; a forest per tile instead of all pairs."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = [np.zeros(0, kind) for kind in (np.int64, np.int32, np.int32, np.int64)]

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal rest
            cut = len(rest[0]) if last else int(np.searchsorted(rest[0], rest[0][-1], "left"))
            now, rest = [column[:cut] for column in rest], [column[cut:] for column in rest]
            members, roots = compare(*now[:3], now[3].view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(now[3][members]), pa.array(now[3][roots])], names=["left_node", "right_node"])

        for batch in batches:
            rest = [np.concatenate([old, new.to_numpy(zero_copy_only=False).astype(old.dtype)]) for old, new in zip(rest, batch.columns, strict=True)]
            if len(rest[0]) >= BUFFER_ROWS:
                yield flush(False)
        if len(rest[0]):
            yield flush(True)

    dealt = tiles(distinct, radius, tile_rows).select("tile", "side", "ones", "fingerprint_bits")
    return dealt.repartition("tile").sortWithinPartitions("tile", "ones").mapInArrow(search, "left_node long, right_node long")


def grouped(documents: DataFrame, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex), ``component_id`` and ``component`` (one fingerprint of it, also where no row has an id) of every document."""
    prints = written(fingerprints(documents), "fingerprints")
    distinct = written(prints.groupBy("fingerprint_bits").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("n")), "distinct-fingerprints")
    joined = components(links(distinct, radius)).withColumnRenamed("node", "fingerprint_bits").join(distinct, "fingerprint_bits")
    named = joined.select("fingerprint_bits", "component").join(
        joined.groupBy("component").agg(F.min("least_id").alias("linked_id")), "component").select("fingerprint_bits", "component", "linked_id")
    # Only fingerprints with company are looked up; a text that is alone names its own class.
    classes = distinct.join(named, "fingerprint_bits", "left").filter("n > 1 or component is not null").select(
        "fingerprint_bits", F.coalesce("linked_id", "least_id").alias("class_id"), F.coalesce("component", "fingerprint_bits").alias("class"))
    classes, small = measured(classes, "classes")
    if small:
        placed = prints.join(F.broadcast(classes), "fingerprint_bits", "left")
    else:  # a fingerprint that a large part of the rows share is spread over salts
        salted = classes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        placed = prints.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["fingerprint_bits", "salt"], "left")
    return placed.select("doc_id", F.lpad(F.lower(F.hex("fingerprint_bits")), 16, "0").alias("fingerprint"),
                         F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("component_id"),
                         F.coalesce("class", "fingerprint_bits").alias("component"))


def near_duplicates(documents: DataFrame, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (hex) and ``component_id`` of every document."""
    return grouped(documents, radius).drop("component")


def keep_one_of_each(documents: DataFrame) -> DataFrame:
    """Pipeline stage: one row of every component stays, with its columns.

    It is the row with the smallest id (rows without one last), then the least fingerprint, then the least hash of text and columns.
    A row is known by its id and its fingerprint, so texts that share an id are judged each for itself. Most ids stay or go as a whole
    and only they are compared; the rows of the others, and rows without id, are fingerprinted again. Texts are shuffled only
    if the ids to drop are too many to broadcast.
    """
    groups = written(grouped(documents), "groups")
    pairs = written(groups.groupBy("doc_id", "fingerprint").agg(F.count("*").alias("n"), F.min("component").alias("component")), "pairs")
    order = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "fingerprint")
    firsts = written(pairs.groupBy("component").agg(F.min(order).alias("first")).select(
        F.col("first.doc_id").alias("first_id"), F.col("first.fingerprint").alias("first_fingerprint")), "firsts")
    mine = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("fingerprint") == F.col("first_fingerprint"))
    stays = F.col("first_fingerprint").isNotNull()
    ids = pairs.filter("doc_id is not null").join(firsts, mine, "left").groupBy("doc_id").agg(
        F.bool_or(stays).alias("some"), F.bool_and(stays & (F.col("n") == 1)).alias("whole"))
    decided = written(ids.filter("not whole").withColumnRenamed("doc_id", "decided_id"), "decided")
    this = F.col("doc_id") == F.col("decided_id")

    def sent(rows: DataFrame, name: str) -> DataFrame:
        kept, small = measured(rows.select("decided_id"), name)
        return F.broadcast(kept) if small else kept

    rows = packed(documents, "doc_id", "text")
    plain = rows.filter("doc_id is not null").join(sent(decided, "not-whole"), this, "left_anti")
    careful = rows.filter("doc_id is null").union(rows.join(sent(decided.filter("some"), "in-part"), this, "left_semi"))
    least = F.struct(F.xxhash64("text"), F.xxhash64(F.to_json(F.struct(*rows.columns))))
    again = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("fingerprint_text") == F.col("first_fingerprint"))
    chosen = fingerprinted_rows(careful).join(firsts, again, "left_semi").groupBy("doc_id", "fingerprint_text").agg(
        F.min_by(F.struct(*rows.columns), least).alias("first")).select("first.*")
    return unpacked(plain.union(chosen), documents.columns)


def fingerprinted_rows(documents: DataFrame) -> DataFrame:
    """Whole rows with their ``fingerprint_text``; used for the rows that an id alone does not tell apart."""
    compute = F.pandas_udf(lambda texts: texts.map(lambda text: f"{fingerprint(text) & (1 << 64) - 1:016x}"), "string")
    return documents.withColumn("fingerprint_text", compute(F.coalesce("text", F.lit(""))))

"""Operator 10, mixing sources to target weights, with DataFrame functions only.

Words are added up per source, every source gets a share of the mixture by its weight, and target / size is the repetition
rate of its documents: each is taken floor(rate) times, and once more if a number in [0, 1) hashed from the seed and its id, or its text if it has none, is below the
fraction. Where a share exceeds ``most`` times the source, it stops there and the excess goes to the others by weight.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that repeat an id
get the same number of copies each; rows without an id are told apart by their texts; a source without words has target 0 and takes none; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import packed, unpacked, written
from tasklore.operators.ranking import with_position
from tasklore.operators.sizing import measured

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 20_240
WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_BYTES = 32 * 1024 * 1024


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``source_name, source_size, target`` per source.

    The shares are those of a level: min(most * size, level * weight). The level starts at even shares and rises while sources
    reach their limit; each round is one aggregation over the source table, and a source that is full stays full.
    """
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("nameless", F.col("source").isNull())
    listed = F.array(*[F.lit(float(weight)) for weight in weights])
    ranked = with_position(sums, "nameless", "source").select(
        F.col("source").alias("source_name"), "source_size", (F.lit(most) * F.col("source_size")).alias("limit"),
        listed[(F.col("position") % len(weights)).cast("int")].alias("weight"))
    sources = written(ranked, "source-weights")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        over = F.col("limit") <= F.lit(level) * F.col("weight")
        row = sources.agg(F.sum(F.when(over, F.col("limit"))), F.sum(F.when(~over, F.col("weight"))), F.count_if(over)).first()
        if row[1] is None or row[2] == full:
            break
        full = row[2]
        level = max(level, (total - (row[0] or 0.0)) / row[1])
    target = F.least(F.col("limit"), F.lit(level) * F.col("weight"))
    return sources.select("source_name", "source_size", target.alias("target"))


def coin_key(doc_id: Column, text: Column) -> Column:
    """What the coin of a document is thrown on: its id, or a hash of its text if it has none."""
    return F.coalesce(doc_id, F.xxhash64(text))


def copies(key: Column, source_size: Column, target: Column, seed: int = SEED) -> Column:
    """How often a document is taken: the whole part of the rate, plus a coin of the fraction thrown by hash."""
    rate = F.when(source_size > 0, target / source_size).otherwise(0.0)
    coin = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return (F.floor(rate) + F.when(coin < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def with_copies(rows: DataFrame, sized: DataFrame, seed: int = SEED) -> DataFrame:
    """``rows`` (coin_key, source, ...) with their source's size and target, and how often each is taken."""
    goal, small = measured(targets(sized), "source-targets", BROADCAST_BYTES)
    joined = rows.join(F.broadcast(goal) if small else goal, F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name")
    return joined.withColumn("copies", copies(F.col("coin_key"), F.col("source_size"), F.col("target"), seed)).drop("coin_key")


def mixture(documents: DataFrame) -> DataFrame:
    """The contract of op10: what the mixture takes of every document."""
    sized = written(documents.select("doc_id", "source", size_in_words(F.col("text")).alias("size"), coin_key(F.col("doc_id"), F.col("text")).alias("coin_key")), "sizes")
    return with_copies(sized, sized).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix(documents: DataFrame) -> DataFrame:
    """Pipeline stage: every document as often as the mixture takes it, with its columns. The text is not shuffled."""
    sized = written(documents.select("source", size_in_words(F.col("text")).alias("size")), "sizes")
    taken = with_copies(packed(documents, "source", "doc_id", "text").withColumn("coin_key", coin_key(F.col("doc_id"), F.col("text"))).drop("doc_id", "text"), sized).filter("copies > 0")
    return unpacked(taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), documents.columns)

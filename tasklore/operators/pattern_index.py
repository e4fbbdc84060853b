"""Patterns as a table: which of very many patterns match a text, without trying each pattern on each text.

Every match of a pattern holds the pattern's literal characters, so a pattern is filed under one piece (gram) of its literals, the
one that fewest patterns share. Grams are nearly as long as the literals, so that patterns with different literals hardly share one, however
many there are. A text is looked up by its own grams of the lengths in use; only patterns found that way, all of whose literals it holds, are tried.
"""

from __future__ import annotations

import re
import re._parser as parser
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklore.functions.rules import java_pattern
from tasklore.operators.sizing import measured

LENGTHS = (1, 2, 3, 4, 6, 8, 12, 16, 24, 32)
SALTS = 16
READ = "literals array<string>, java string"


def required_literals(pattern: str) -> list[str]:
    """The runs of plain ASCII characters that every match must hold, lower-cased."""
    runs: list[str] = [""]

    def walk(tokens) -> None:
        for kind, value in tokens:
            if kind is parser.LITERAL and value < 128:
                runs[-1] += chr(value)
            elif kind is parser.SUBPATTERN:
                walk(value[3])
            elif kind in (parser.MAX_REPEAT, parser.MIN_REPEAT, parser.POSSESSIVE_REPEAT) and value[0] > 0:
                runs.append("")
                walk(value[2])
                runs.append("")
            elif kind is not parser.AT:
                runs.append("")

    walk(parser.parse(pattern))
    return sorted({run.lower() for run in runs if run})


def _read(patterns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in patterns:
        rows = []
        for pattern in batch:
            try:
                rows.append((required_literals(pattern), f"(?dU)^(?:{java_pattern(pattern)})"))
            except (re.error, TypeError, OverflowError):
                rows.append((None, None))
        yield pd.DataFrame(rows, columns=["literals", "java"])


def _step(length: Column) -> Column:
    """The greatest gram length that is no longer."""
    return F.array_max(F.filter(F.array(*map(F.lit, LENGTHS)), lambda step: step <= length))


def _grams(text: Column, length: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(text) - length + 1, F.lit(1)))
    return F.transform(starts, lambda start: F.substring(text, start, length))


def read_patterns(patterns: DataFrame, value: str) -> DataFrame:
    """``position, value, literals, java`` of the patterns that can be read, written once."""
    read = F.pandas_udf(_read, READ)(F.col("pattern")).alias("read")
    found = patterns.select("position", F.col(value).alias("value"), read).select("position", "value", "read.*")
    return measured(found, "patterns-read")[0].filter("java is not null")  # a filter before the write would read patterns twice, below a shuffle that spreads them


def filed(known: DataFrame) -> DataFrame:
    """Read patterns with the ``gram`` and the ``salt`` under which each is filed."""
    sets = known.filter("size(literals) > 0").groupBy("literals").agg(F.count("*").alias("n"))
    own = F.flatten(F.transform("literals", lambda literal: _grams(literal, _step(F.length(literal)))))
    pieces = sets.select("literals", "n", F.explode(F.array_distinct(own)).alias("gram"))
    shared = pieces.groupBy("gram").agg(F.sum("n").alias("sharing"))
    rarest = F.min_by("gram", F.struct("sharing", -F.length("gram"), "gram")).alias("gram")
    chosen = pieces.join(shared, "gram").groupBy("literals").agg(rarest)
    salts = F.explode(F.when(F.col("gram") == "", F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    return known.join(chosen, "literals", "left").withColumn("gram", F.coalesce("gram", F.lit(""))).withColumn("salt", salts)


def first_matches(texts: DataFrame, text: str, patterns: DataFrame, value: str) -> DataFrame:
    """``text`` and the ``value`` of the first pattern, by ``position``, that matches its start; texts without a match are left out.

    ``patterns``: position, pattern, and the value column. Patterns that can't be read match nothing. Those without any literal are tried
    on every text, spread over salts.
    """
    known = read_patterns(patterns, value)
    lengths = known.select(F.explode("literals").alias("literal")).agg(F.collect_set(_step(F.length("literal"))).alias("lengths"))
    asked = texts.select(F.col(text).alias("key")).filter("key is not null").distinct()
    low = F.translate(F.lower("key"), "ſ", "s")  # the one letter beyond ASCII that equals a lower-case ASCII letter when case is ignored
    every = F.concat(F.array(F.lit("")), F.filter(F.flatten(F.transform("lengths", lambda length: _grams(low, length))), lambda gram: gram != ""))
    salt = F.when(F.col("gram") == "", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    looked_up = asked.crossJoin(F.broadcast(lengths)).select("key", F.explode(F.array_distinct(every)).alias("gram")).withColumn("salt", salt)
    held = F.forall("literals", lambda literal: F.contains(low, literal))
    met = looked_up.join(filed(known), ["gram", "salt"]).filter(held & F.rlike("key", F.col("java")))
    return met.groupBy("key").agg(F.min_by("value", "position").alias(value)).withColumnRenamed("key", text)

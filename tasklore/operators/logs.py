"""Raw logs to structured lines.

Two shapes: ``log_entries`` has one row per line for line-level work; ``with_lines`` keeps one row per
try with its lines in an array (bounded by the tail length), so per-try analysis needs no shuffle at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import parsing, templates, text
from tasklore.schemas import TRY_KEY


def log_entries(tries: DataFrame, max_lines: int | None = None, iso: bool = False) -> DataFrame:
    """One row per non-blank line. ``line_number`` counts inside the kept tail, ``orig_line_number`` in the log."""
    lines = tries.select(
        *TRY_KEY, "start_date",
        parsing.dropped_lines(F.col("log_content"), max_lines).alias("dropped"),
        _stripped(parsing.tail(F.col("log_content"), max_lines)),
    ).filter(F.col("item.message") != "")
    raw = F.col("item.raw_content")
    return lines.select(
        *TRY_KEY,
        (F.col("position") + 1).alias("line_number"),
        (F.col("position") + 1 + F.col("dropped")).alias("orig_line_number"),
        parsing.event_time(raw, F.col("start_date"), iso).alias("ts"),
        parsing.level(raw).alias("level"),
        F.col("item.message").alias("message"),
        F.lit(fv.LOG_SOURCE).alias("source"),
        raw.alias("raw_content"),
    )


def _stripped(lines: Column) -> Column:
    """Explode lines together with their stripped text.

    The text is computed before the explode on purpose: a filter on a projected text would be pushed
    down as its defining expression and strip the line again for every rule. The outer form keeps the
    optimizer from evaluating the array twice to test its size; its null row falls to the blank filter.
    """
    both = F.transform(lines, lambda line: F.struct(line.alias("raw_content"), text.strip(line).alias("message")))
    return F.posexplode_outer(both).alias("position", "item")


def with_lines(tries: DataFrame, max_lines: int | None = None, iso: bool = False,
               with_template: bool = False) -> DataFrame:
    """Add ``lines``, the structured lines of the try."""
    return pin(tries, lines=parsing.structured_lines(
        F.coalesce(F.col("log_content"), F.lit("")), F.col("start_date"), max_lines, iso, with_template))


def pin(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row.

    A projected column is only a name to the optimizer: a later filter on it is pushed down as its whole
    defining expression, even into the lambda of another one. Values that come out of a generator are
    not substituted, so costly arrays are passed through a one-element inline.
    """
    once = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select("*", F.inline(F.array(once)))


def with_template(entries: DataFrame) -> DataFrame:
    return entries.withColumn("template", templates.shape_template(F.col("message")))


def text_lines(documents: DataFrame, key: str, body: str) -> DataFrame:
    """Any text column as numbered, stripped, non-blank lines."""
    lines = documents.select(key, _stripped(F.split(F.col(body), "\n")))
    return lines.filter(F.col("item.message") != "").select(
        key, (F.col("position") + 1).alias("line_number"), F.col("item.message").alias("message"))

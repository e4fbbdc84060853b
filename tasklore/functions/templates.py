"""Masking, tokenising and order-free line templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import text


def mask(message: Column) -> Column:
    """Apply the ordered masks; each hit becomes ``<:NAME:>``."""
    for pattern, name in fv.MASKS:
        message = F.regexp_replace(message, pattern, f"{fv.MASK_PREFIX}{name}{fv.MASK_SUFFIX}")
    return message


def normalise(message: Column) -> Column:
    """Masked text with extra delimiters opened up and single blanks between tokens."""
    masked = mask(message)
    for delimiter in fv.EXTRA_DELIMITERS:
        masked = F.replace(masked, F.lit(delimiter), F.lit(" "))
    return text.squeeze(masked)


def tokenize(message: Column) -> Column:
    """Template tokens of a message; blank messages have none."""
    flat = normalise(message)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def shape_template(message: Column) -> Column:
    """Masked token sequence in which every token holding a digit becomes the wildcard.

    Written as one linear regex over the normalised text instead of an array transform, so it stays
    inside generated code.
    """
    return F.regexp_replace(normalise(message), r"(?<![^ ])[^ 0-9]*[0-9][^ ]*", fv.WILDCARD)

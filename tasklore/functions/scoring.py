"""Keyword rules that categorise and rate an error text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import text


def category(error: Column) -> Column:
    """First matching keyword set wins."""
    lowered = F.lower(error)
    result: Column = F.lit("unknown")
    for name, terms in reversed(fv.CATEGORY_TERMS):
        result = F.when(text.contains_any(lowered, terms), F.lit(name)).otherwise(result)
    return result


def severity(error: Column) -> Column:
    return F.when(text.contains_any(F.lower(error), fv.HIGH_SEVERITY_TERMS), "high").otherwise("medium")


def confidence(error: Column) -> Column:
    length = F.length(error)
    return (F.when((length > 10) & F.lower(error).contains("error"), 0.85)
            .when(length > 5, 0.70).otherwise(0.50))


def reasoning(category_name: Column) -> Column:
    table = F.create_map(*[F.lit(part) for pair in fv.REASONING.items() for part in pair])
    return F.coalesce(F.try_element_at(table, category_name), F.lit(fv.REASONING_DEFAULT))


def structured_output(error: Column) -> Column:
    """Struct of the six answer fields derived from an error line."""
    name = category(error)
    return F.struct(
        error.alias("error_message"),
        confidence(error).alias("confidence"),
        name.alias("category"),
        severity(error).alias("severity"),
        reasoning(name).alias("reasoning"),
        F.array(error).alias("error_lines"),
    )


def rate_candidate(error: Column) -> Column:
    """Second rule set: struct of category, severity, confidence and reasoning."""
    lowered = F.lower(error)

    def verdict(name: str, level: str, sure: float, why: str) -> Column:
        return F.struct(F.lit(name).alias("category"), F.lit(level).alias("severity"),
                        F.lit(sure).alias("confidence"), F.lit(why).alias("reasoning"))

    result = verdict(*fv.CATEGORY_V2_DEFAULT)
    for groups, *labels in reversed(fv.CATEGORY_TERMS_V2):
        test = reduce(lambda a, b: a & b, [text.contains_any(lowered, terms) for terms in groups])
        result = F.when(test, verdict(*labels)).otherwise(result)
    return result


def error_line(lines: Column) -> Column:
    """Error line of an ordered ``array<struct<level, message>>``.

    First line at an error level, else first line with an error keyword, else the last line, else a
    fixed text. Arrays are bounded by the tail length, so this stays inside the row.
    """
    by_level = F.filter(lines, lambda item: F.upper(item["level"]).isin(*fv.ERROR_LEVELS))
    by_word = F.filter(lines, lambda item: text.contains_any(F.lower(item["message"]), fv.ERROR_KEYWORDS))
    return F.coalesce(
        F.get(by_level, F.lit(0))["message"],
        F.get(by_word, F.lit(0))["message"],
        F.try_element_at(lines, F.lit(-1))["message"],
        F.lit(fv.NO_DETAILS),
    )


def answered_line(lines: Column, answer: Column) -> Column:
    """A model answer for the error line; empty or meaningless answers fall back to the rules."""
    cleaned = text.strip(answer)
    usable = text.present(cleaned) & ~F.lower(cleaned).isin(*fv.EMPTY_ANSWERS)
    return (F.when(F.size(F.coalesce(lines, F.array())) == 0, F.lit(fv.NO_DETAILS))
            .when(usable, text.short_text(cleaned)).otherwise(error_line(lines)))


def context(lines: Column, last: int = fv.CONTEXT_LINES) -> Column:
    """The last lines as ``[time] LEVEL: message`` joined by newlines."""
    start = F.greatest(F.size(lines) - F.lit(last) + 1, F.lit(1))
    recent = F.slice(lines, start, F.lit(last))
    return F.array_join(F.transform(recent, lambda item: F.concat(
        F.lit("["), text.time_text(item["ts"]), F.lit("] "),
        item["level"], F.lit(": "), item["message"])), "\n")


def joined_messages(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda item: item["message"]), "\n")

"""One log text to structured lines. Works per line (Column in, Column out) or on a whole log as an array."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import templates, text

TIME = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
TIME_ISO = r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2})"
LEVEL = r"(?i)\b(" + "|".join(fv.LOG_LEVELS) + r")\b"
ID_VALUE = r"[=:]\s*['\"]?([^'\",$\s]+)"


def event_time(line: Column, fallback: Column, iso: bool = False) -> Column:
    """First date and time in the line; impossible or absent times give the fallback."""
    found = F.regexp_extract(line, TIME_ISO if iso else TIME, 1)
    if iso:
        found = F.translate(found, "T", " ")
    return F.coalesce(found.try_cast("timestamp_ntz"), fallback.cast("timestamp_ntz"))


def level(line: Column) -> Column:
    """First level word of the line in upper case, or the default level."""
    found = F.upper(F.regexp_extract(line, LEVEL, 1))
    return F.when(found == "", F.lit(fv.DEFAULT_LEVEL)).otherwise(found)


def tail(log: Column, max_lines: int | None = None) -> Column:
    """The lines of a log as an array; with ``max_lines``, the last ones (slice with a negative start would lose short logs)."""
    lines = F.split(log, "\n")
    if max_lines is None:
        return lines
    start = F.greatest(F.size(lines) - F.lit(max_lines) + 1, F.lit(1))
    return F.slice(lines, start, F.lit(max_lines))


def dropped_lines(log: Column, max_lines: int | None = None) -> Column:
    """How many leading lines the tail leaves out."""
    if max_lines is None:
        return F.lit(0)
    return F.greatest(F.size(F.split(log, "\n")) - F.lit(max_lines), F.lit(0))


def structured_lines(log: Column, fallback: Column, max_lines: int | None = None, iso: bool = False,
                     with_template: bool = False) -> Column:
    """Whole log to ``array<struct>`` of its non-blank lines, without leaving the row.

    The line number counts blank lines and starts at 1 inside the kept tail.
    """
    def one(line: Column, position: Column) -> Column:
        fields = [
            (position + 1).alias("line_number"),
            event_time(line, fallback, iso).alias("ts"),
            level(line).alias("level"),
            text.strip(line).alias("message"),
            line.alias("raw_content"),
        ]
        return F.struct(*fields)

    lines = F.filter(F.transform(tail(log, max_lines), one), lambda item: item["message"] != "")
    if not with_template:
        return lines
    return F.transform(lines, lambda item: item.withField("template", templates.shape_template(item["message"])))


def extract_id(log: Column, name: str) -> Column:
    """Value written after NAME= or NAME: in a text, or ``unknown``."""
    found = F.regexp_extract(log, name + ID_VALUE, 1)
    return F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown"))


def parse_offset(offset: str) -> timedelta | None:
    """``±HH:MM`` to a shift; zero or malformed offsets give None."""
    if offset == "+00:00":
        return None
    parts = offset[1:].split(":")
    if len(parts) != 2:
        return None
    try:
        hours, minutes = (int(part) for part in parts)
    except ValueError:
        return None
    shift = timedelta(hours=hours, minutes=minutes)
    return shift if offset[0] == "+" else -shift


def shift_time(ts: Column, offset: str) -> Column:
    shift = parse_offset(offset)
    return ts if shift is None else ts + F.lit(shift)

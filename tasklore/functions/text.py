"""Text helpers shared by all column functions. Every function takes and returns a Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv

# Whitespace as str.strip() sees it; Java's \s alone is narrower.
WS = r"[\p{IsWhite_Space}\x1c-\x1f]"
WS_CHARS = "".join(ch for ch in map(chr, range(0x10000)) if ch.isspace())


def strip(text: Column) -> Column:
    """Remove whitespace of any kind at both ends (plain trim() removes blanks only); looks at the ends, not the text."""
    return F.btrim(text, F.lit(WS_CHARS))


def squeeze(text: Column) -> Column:
    """Strip, then turn every run of whitespace into one blank. A single blank is one already and is left alone."""
    return F.regexp_replace(strip(text), f"{WS}{{2,}}|(?! ){WS}", " ")


def tokens(text: Column) -> Column:
    """Whitespace tokens; a blank text has none."""
    flat = squeeze(text)
    return F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))


def cut(text: Column, limit: int, keep: int) -> Column:
    """Texts longer than ``limit`` keep their first ``keep`` characters followed by three dots."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, keep), F.lit("..."))).otherwise(text)


def preview(text: Column, chars: int = fv.PREVIEW_CHARS) -> Column:
    return cut(text, chars, chars)


def short_text(text: Column, chars: int = fv.SHORT_TEXT_CHARS) -> Column:
    return cut(text, chars, chars - 3)


def contains_any(text: Column, terms: list[str]) -> Column:
    """True when at least one term occurs in the text."""
    hit = F.lit(False)
    for term in terms:
        hit = hit | text.contains(term)
    return hit


def present(text: Column) -> Column:
    """Not null and not empty."""
    return text.isNotNull() & (text != "")


def first_present(*texts: Column) -> Column:
    """First value that is neither null nor empty; the last argument is returned as it is."""
    *head, last = texts
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in head], last)


def round_half_up(value: Column, digits: int) -> Column:
    """Half-up rounding in binary floating point, the same in every engine."""
    scale = float(10 ** digits)
    return F.floor(value * scale + 0.5) / scale


def time_text(ts: Column, separator: str = " ") -> Column:
    """Date and time with six fraction digits, or none when the fraction is zero."""
    whole = F.concat(F.date_format(ts, "yyyy-MM-dd"), F.lit(separator), F.date_format(ts, "HH:mm:ss"))
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat(whole, F.lit("."), micros))


def glob_to_regex(pattern: str) -> str:
    """Shell glob to an anchored, case-insensitive regex (built once on the driver)."""
    out, i = [], 0
    while i < len(pattern):
        ch = pattern[i]
        close = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1:close].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        elif ch.isalnum() or ch == "_":
            out.append(ch)
        else:
            out.append("\\" + ch)
        i += 1
    return "(?is)^" + "".join(out) + r"\z"


def matches_glob(text: Column, pattern: str) -> Column:
    return text.rlike(glob_to_regex(pattern))


# Redaction steps: (pattern, replacement), applied in order. Possessive runs keep them linear.
REDACTIONS = [
    (r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "<EMAIL>"),
    (r"(?i)(password|passwd|pwd|secret|token|api[_-]?key)(\s*[=:]\s*)[^\s,;]+", "$1$2<SECRET>"),
    (r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?![0-9.])", "<ADDRESS>"),
    (r"[0-9a-fA-F]{32,}", "<HEX>"),
    (r"[0-9]{9,}", "<DIGITS>"),
]


def redact(text: Column) -> Column:
    """Mask e-mail addresses, secrets in key = value form, network addresses and long digit or hex runs."""
    for pattern, replacement in REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text

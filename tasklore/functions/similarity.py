"""Answer comparison: cleaning, exact match, term recall, token overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import text


def clean(answer: Column) -> Column:
    """Single blanks, no outer whitespace, listed prefixes removed one after the other."""
    body = text.squeeze(answer)
    for prefix in fv.ANSWER_PREFIXES:
        body = F.when(body.startswith(prefix), text.strip(F.substring(body, len(prefix) + 1, 2 ** 31 - 1))).otherwise(body)
    return body


def exact_match(left: Column, right: Column) -> Column:
    return F.lower(left) == F.lower(right)


def error_terms(cleaned: Column) -> Column:
    """Distinct key terms of a cleaned text: coded errors, keywords and quoted strings."""
    found = [F.regexp_extract_all(cleaned, F.lit("(?i)" + pattern), F.lit(0)) for pattern in fv.TERM_PATTERNS]
    found.append(F.regexp_extract_all(cleaned, F.lit(fv.QUOTED_PATTERN), F.lit(1)))
    return F.array_distinct(F.concat(*found))


def term_recall(generated: Column, expected: Column) -> Column:
    """Enough of the expected terms occur in the generated text; no terms means no."""
    terms = error_terms(expected)
    lowered = F.lower(generated)
    found = F.size(F.filter(terms, lambda term: lowered.contains(F.lower(term))))
    return F.coalesce(F.try_divide(found, F.size(terms)) >= fv.TERM_RECALL, F.lit(False))


def jaccard(left: Column, right: Column) -> Column:
    """Overlap of the lower-cased token sets."""
    a = F.array_distinct(text.tokens(F.lower(left)))
    b = F.array_distinct(text.tokens(F.lower(right)))
    shared = F.size(F.array_intersect(a, b))
    everything = F.size(a) + F.size(b) - shared
    return F.when(everything == 0, F.lit(1.0)).otherwise(shared / F.greatest(everything, F.lit(1)))

"""Parsing of free-text answers into typed analysis fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import text

ANSWER_SCHEMA = (
    "struct<error_message:string,confidence:string,category:string,severity:string,"
    "error_lines:array<string>,reasoning:string,_corrupt_record:string>"
)


def _unfence(answer: Column) -> Column:
    """Drop an opening json fence and a closing fence."""
    body = text.strip(answer)
    body = F.when(body.startswith("```json"), F.substring(body, 8, 2 ** 31 - 1)).otherwise(body)
    body = F.when(body.endswith("```"), F.left(body, F.length(body) - 3)).otherwise(body)
    return text.strip(body)


def fallback(reason: Column) -> Column:
    """Analysis used when no answer could be read."""
    return F.struct(
        F.concat(F.lit(fv.FALLBACK_PREFIX), reason).alias("error_message"),
        F.lit(0.1).alias("confidence"),
        F.lit("unknown").alias("category"),
        F.lit("medium").alias("severity"),
        F.array(*[F.lit(a) for a in fv.FALLBACK_ACTIONS]).alias("suggested_actions"),
        F.array().cast("array<string>").alias("raw_error_lines"),
        F.lit(fv.FALLBACK_REASONING).alias("reasoning"),
    )


def no_error_result() -> Column:
    """Analysis of a try in which no candidate line survived."""
    return F.struct(
        F.lit(fv.NO_PATTERNS).alias("error_message"),
        F.lit(0.1).alias("confidence"),
        F.lit("unknown").alias("category"),
        F.lit("low").alias("severity"),
        F.array(F.lit(fv.REVIEW_MANUALLY)).alias("suggested_actions"),
        F.array().cast("array<string>").alias("raw_error_lines"),
        F.lit("").alias("reasoning"),
    )


def parse_answer(answer: Column, categories: list[str] | None = None) -> Column:
    """A JSON answer as an analysis struct; unreadable answers and unknown labels give the fallback.

    Malformed JSON parses to a struct of nulls, so failure is read from the corrupt-record field. The text must be one object and
    nothing else; a null or a number where a text belongs is unreadable, unlike a field that is absent. So is a repeated field.
    """
    names = fv.CATEGORIES if categories is None else categories
    data = F.from_json(_unfence(answer), ANSWER_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt_record"})
    sure = F.when(data["confidence"].isNull(), F.lit(0.5)).otherwise(data["confidence"].try_cast("double"))
    name = F.coalesce(data["category"], F.lit("unknown"))
    level = F.coalesce(data["severity"], F.lit("medium"))
    readable = data.isNotNull() & data["_corrupt_record"].isNull()
    # As the only element of an array, an object can't be followed by anything.
    whole = F.try_parse_json(F.concat(F.lit("["), _unfence(answer), F.lit("]")))

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get(whole, path, "variant")), F.lit("absent"))

    readable &= whole.isNotNull() & (kind("$[1]") == "absent") & (kind("$[0].confidence") != "VOID")
    for field in ("error_message", "category", "severity"):
        readable &= kind(f"$[0].{field}").isin("absent", "STRING")
    valid = readable & sure.isNotNull() & name.isin(*names) & level.isin(*fv.SEVERITIES)
    parsed = F.struct(
        F.coalesce(data["error_message"], F.lit(fv.UNKNOWN_ERROR)).alias("error_message"),
        sure.alias("confidence"),
        name.alias("category"),
        level.alias("severity"),
        F.array().cast("array<string>").alias("suggested_actions"),
        F.coalesce(data["error_lines"], F.array().cast("array<string>")).alias("raw_error_lines"),
        F.coalesce(data["reasoning"], F.lit("")).alias("reasoning"),
    )
    return F.when(valid, parsed).otherwise(fallback(F.lit("Parse error")))


def parse_category(answer: Column, categories: list[str] | None = None) -> Column:
    """A one-word category answer, unfenced; anything outside the list is unknown."""
    names = fv.CATEGORIES if categories is None else categories
    body = F.lower(text.strip(answer))
    body = F.regexp_replace(body, r"(?d)^```.*\n", "")
    body = text.strip(F.regexp_replace(body, r"\n```\z", ""))
    return F.when(body.isin(*names), body).otherwise("unknown")


def parse_steps(answer: Column) -> Column:
    """Numbered or bulleted lines of an answer without their marks."""
    lines = F.transform(F.split(text.strip(answer), "\n"), text.strip)
    marked = F.filter(lines, lambda line: line.rlike(r"^[0-9*-]"))
    bare = F.transform(marked, lambda line: F.regexp_replace(
        F.regexp_replace(line, rf"^[0-9]+\.?{text.WS}*", ""), rf"^[-*]{text.WS}*", ""))
    steps = F.filter(bare, lambda line: line != "")
    return F.when(F.size(steps) > 0, steps).otherwise(F.array(F.lit(fv.NO_STEPS)))

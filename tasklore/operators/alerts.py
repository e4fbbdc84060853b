"""Alert rows: which results to report, to whom, with what text. Nothing is sent."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import text
from tasklore.functions.rules import java_pattern
from tasklore.operators import pattern_index

# The recipient table is configuration; above this size the expression would no longer be small.
MAX_PATTERNS = 2000


def alert_results(results: DataFrame, severity: str = "severity") -> DataFrame:
    """Results rated high or critical."""
    return results.filter(F.col(severity).isin(*fv.ALERT_SEVERITIES))


def recipients(key: Column, patterns: Mapping[str, Sequence[str]], default: Sequence[str]) -> Column:
    """Recipients of the first pattern that matches the start of ``dag.task``, else the default list.

    The patterns are driver-side configuration, compiled to one expression: no join and no row explosion.
    """
    if len(patterns) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} recipient patterns; keep them in a table (table_recipients)")

    def names(values: Sequence[str]) -> Column:
        return F.array(*[F.lit(v) for v in values]).cast("array<string>")

    if not patterns:
        return names(default)
    chosen = F  # one flat CASE in pattern order
    for pattern, values in patterns.items():
        re.compile(pattern)
        chosen = chosen.when(key.rlike(f"^(?:{java_pattern(pattern)})"), names(values))
    return chosen.otherwise(names(default))


def task_key() -> Column:
    return F.concat("dag_id", F.lit("."), "task_id")


def with_recipients(results: DataFrame, patterns: Mapping[str, Sequence[str]], default: Sequence[str]) -> DataFrame:
    """One row per (result, recipient)."""
    return results.withColumn("recipient", F.explode(recipients(task_key(), patterns, default)))


def table_recipients(results: DataFrame, patterns: DataFrame, default: Sequence[str], key: str = "task_key") -> DataFrame:
    """Add ``recipients`` by a pattern table (position, pattern, recipients) of any size: the first match of the key's start, else the default."""
    found = pattern_index.first_matches(results, key, patterns, "recipients")
    usual = F.array(*[F.lit(name) for name in default]).cast("array<string>")
    return results.join(found, key, "left").withColumn("recipients", F.coalesce("recipients", usual))


def sms_text(error: Column, severity: Column, title: str = "Alert", key: Column | None = None) -> Column:
    """Short alert text, cut to the length of one message."""
    body = F.concat(F.lit(f"{title}: "), task_key() if key is None else key, F.lit(" failed. Error: "),
                    F.left(error, F.lit(fv.PREVIEW_CHARS)), F.lit("... Severity: "), severity)
    return F.left(body, F.lit(fv.SHORT_TEXT_CHARS))


def email_text(error: Column, category: Column, severity: Column, confidence: Column, actions: Column,
               at: Column, title: str = "Alert") -> Column:
    """HTML body of an alert with the confidence in percent and the suggested actions as a list.

    ``at`` is the time as text (see ``functions.text.time_text``).
    """
    def row(name: str, value: Column) -> list[Column]:
        return [F.lit(f"<p><strong>{name}:</strong> "), value, F.lit("</p>\n")]

    items = F.array_join(F.transform(actions, lambda a: F.concat(F.lit("<li>"), a, F.lit("</li>"))), "")
    return F.concat(
        F.lit(f"<html>\n<body>\n<h2>{title}</h2>\n"), *row("Task", task_key()), *row("Run ID", F.col("run_id")),
        *row("Error", error), *row("Category", category), *row("Severity", severity),
        *row("Confidence", F.format_string("%.1f%%", confidence * 100)),
        F.lit("<h3>Suggested Actions:</h3>\n<ul>"), items, F.lit("</ul>\n<p><em>Generated at "),
        at, F.lit("</em></p>\n</body>\n</html>"))


def _event(kind: str, at: Column, payload: Column, keyed: bool = True) -> list[Column]:
    ids = [F.col(c) if keyed else F.lit(None).cast("string").alias(c) for c in ("dag_id", "task_id", "run_id")]
    return [F.lit(kind).alias("event_type"), *ids,
            F.to_json(payload, {"ignoreNullFields": "false"}).alias("data"), at.alias("timestamp")]


def new_failures(failures: DataFrame) -> DataFrame:
    payload = F.struct("error_message", text.time_text(F.col("ts"), "T").alias("timestamp"),
                       F.coalesce("severity", F.lit("unknown")).alias("severity"))
    return failures.select(*_event("new_failure", F.col("ts"), payload))


def completed_analyses(results: DataFrame) -> DataFrame:
    payload = F.struct(F.col("id").alias("analysis_id"), "success", "processing_time", "error_message", "category", "severity")
    return results.select(*_event("analysis_complete", F.col("ts"), payload))


def status_changes(statistics: DataFrame, at: Column) -> DataFrame:
    payload = F.struct(F.struct(*statistics.columns).alias("monitor_status"), text.time_text(at, "T").alias("timestamp"))
    return statistics.select(*_event("status_change", at, payload, keyed=False))

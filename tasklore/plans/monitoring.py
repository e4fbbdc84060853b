"""End-to-end plans: notification rows of a batch, and the continuous analysis of failed tries."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tasklore.functions import fixed_values as fv
from tasklore.functions import rules
from tasklore.operators import alerts
from tasklore.plans import failure_analysis as plan
from tasklore.schemas import TRY_KEY
from tasklore.streaming import failures as stream


def notifications(analysed: DataFrame, patterns: Mapping[str, Sequence[str]], default: Sequence[str]) -> DataFrame:
    """One short text per analysed try and recipient."""
    return alerts.with_recipients(plan.summaries(analysed), patterns, default)


def analyse_stream(tries: DataFrame, baseline: DataFrame, rule_set: rules.RuleSet | None = None,
                   max_lines: int | None = None, delay: str = "1 day") -> DataFrame:
    """Failed tries with their logs, as they arrive, to analysed results.

    The per-try operators are the ones of the batch plan: a try stays one row and only meets the stored
    baseline, so the stream needs no state but the keys already seen inside the watermark.
    """
    chosen = rules.preset("notification") if rule_set is None else rule_set
    fresh = stream.once_per_try(stream.with_event_time(stream.failed_tries(tries), delay=delay))
    texts = fresh.select(*TRY_KEY, "start_date", "log_content")
    return plan.analyse(plan.compare(plan.candidates_per_try(texts, baseline, chosen, max_lines)))


def analyse_batches(tries: DataFrame, baseline: Callable[[], DataFrame], path: str, checkpoint: str, rule_set: rules.RuleSet | None = None,
                    max_lines: int | None = None, delay: str = "1 day", exact: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """As ``analyse_stream``, written below ``path/batch_id=``; every batch meets the baseline that is newest when it starts.

    ``baseline`` is asked once a batch, for instance for the templates of a store that another query refreshes; ``exact`` uses the tree.
    """
    chosen = rules.preset("notification") if rule_set is None else rule_set
    fresh = stream.once_per_try(stream.with_event_time(stream.failed_tries(tries), delay=delay)).select(*TRY_KEY, "start_date", "log_content")

    def analysed(batch: DataFrame) -> DataFrame:
        return flat_results(plan.analyse(plan.compare(plan.candidates_per_try(batch, baseline(), chosen, max_lines, exact))))

    return stream.to_batches(fresh, path, checkpoint, transform=analysed, trigger=trigger)


def flat_results(analysed: DataFrame) -> DataFrame:
    """The analysis fields next to the key and the counts."""
    return analysed.select(
        *TRY_KEY, "n_lines", "n_anomalous", "n_candidates", "novelty_score", "is_known_pattern", "analysis.error_message",
        "analysis.confidence", "analysis.category", "analysis.severity", "analysis.reasoning",
        F.array_join("analysis.suggested_actions", "|").alias("actions"))

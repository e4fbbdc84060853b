"""The review queue: filters, statistics, reviews and exports of error candidates and analysis history."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import scoring, text
from tasklore.functions.parsing import extract_id

# Review actions as they arrive, and the status they mean.
ACTION_STATUS = {"approve": "approved", "reject": "rejected", "modify": "modified"}


def history(records: DataFrame, dag_id: str | None = None, task_id: str | None = None, limit: int | None = 50) -> DataFrame:
    """Newest analyses, optionally of one dag or task, with shortened error texts."""
    for name, wanted in (("dag_id", dag_id), ("task_id", task_id)):
        if wanted:
            records = records.filter(F.col(name) == wanted)
    listed = records.withColumn("error_message", text.preview(F.col("error_message"))).orderBy(F.col("ts").desc(), "id")
    return listed if limit is None else listed.limit(limit)


def queue(candidates: DataFrame, status: str | None = None, category: str | None = None, severity: str | None = None,
          limit: int = 50, offset: int = 0) -> DataFrame:
    """One page of candidates, newest first; labels match the model's or the reviewer's."""
    if status:
        candidates = candidates.filter(F.col("status") == status)
    if category:
        candidates = candidates.filter((F.col("llm_category") == category) | (F.col("human_category") == category))
    if severity:
        candidates = candidates.filter((F.col("llm_severity") == severity) | (F.col("human_severity") == severity))
    return candidates.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def export_selection(candidates: DataFrame, include_rejected: bool = False, categories: list[str] | None = None,
                     severities: list[str] | None = None, min_confidence: float | None = None) -> DataFrame:
    """Candidates to export; a label filter looks at the reviewer's label, else the model's."""
    if not include_rejected:
        candidates = candidates.filter(F.col("status") != "rejected")
    if categories:
        candidates = candidates.filter(F.coalesce("human_category", "llm_category").isin(*categories))
    if severities:
        candidates = candidates.filter(F.coalesce("human_severity", "llm_severity").isin(*severities))
    if min_confidence:
        candidates = candidates.filter(F.col("llm_confidence") >= min_confidence)
    return candidates


def reviewed(candidates: DataFrame) -> DataFrame:
    """Candidates with a usable human text and an accepted status."""
    note = F.col("human_feedback")
    return candidates.filter(note.isNotNull() & (note != "null") & (text.strip(note) != "")
                             & F.col("status").isin(*fv.REVIEWED_STATUSES))


def statistics(candidates: DataFrame) -> DataFrame:
    """Counts per status, acceptance rate and average confidence in one pass."""
    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status)

    accepted = count("approved") + count("modified")
    return candidates.agg(
        F.count("*").alias("total_candidates"), count("pending").alias("pending_review"),
        count("approved").alias("approved"), count("rejected").alias("rejected"), count("modified").alias("modified"),
        F.coalesce(F.try_divide(accepted, accepted + count("rejected")), F.lit(0.0)).alias("accuracy_rate"),
        F.coalesce(F.avg("llm_confidence"), F.lit(0.0)).alias("avg_confidence"))


def unlabelled(candidates: DataFrame) -> DataFrame:
    return candidates.filter((F.col("status") == "pending") & F.col("llm_category").isNull())


def next_to_label(candidates: DataFrame, limit: int = 50) -> DataFrame:
    """The next pending candidates without a model label and how many remain after them."""
    waiting = unlabelled(candidates)
    total = waiting.agg(F.count("*")).scalar()
    return (
        waiting.withColumn("remaining_pending", F.greatest(total - limit, F.lit(0)))
        .orderBy(F.col("created_at").desc(), "id").limit(limit)
    )


def label(candidates: DataFrame) -> DataFrame:
    """Rate candidates with the second rule set."""
    verdict = scoring.rate_candidate(F.col("error_message"))
    return candidates.withColumn("v", verdict).withColumns({
        "llm_category": F.col("v.category"), "llm_severity": F.col("v.severity"),
        "llm_confidence": F.col("v.confidence"), "llm_reasoning": F.col("v.reasoning")}).drop("v")


def from_analyses(results: DataFrame, created_at: datetime) -> DataFrame:
    """Analysis rows as pending candidates. The id is a hash of the source row, so a retried task repeats it."""
    def given(name: str, default: str) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in results.columns else F.lit(default)

    def label_of(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in results.columns else F.lit(None).cast(kind)

    return results.select(
        F.sha2(F.concat_ws("|", "id", "dag_id", "task_id", "run_id"), 256).alias("id"),
        given("dag_id", "unknown").alias("dag_id"), given("task_id", "unknown").alias("task_id"),
        given("run_id", "unknown").alias("run_id"), given("error_message", "").alias("error_message"),
        given("raw_logs", "").alias("raw_logs"), label_of("category").alias("llm_category"),
        label_of("severity").alias("llm_severity"), label_of("confidence", "double").alias("llm_confidence"),
        label_of("reasoning").alias("llm_reasoning"), F.lit("pending").alias("status"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
        F.coalesce("processing_time", F.lit(0.0)).alias("processing_time"))


def apply_reviews(candidates: DataFrame, reviews: DataFrame) -> DataFrame:
    """Merge review decisions: the latest decision per candidate sets status, labels, reviewer and time.

    ``reviews``: candidate_id, action, human_category, human_severity, feedback_notes, reviewer_name, reviewed_at.
    """
    status = F.col("action")
    for action, meaning in ACTION_STATUS.items():
        status = F.when(F.col("action") == action, F.lit(meaning)).otherwise(status)
    decision = F.struct(
        status.alias("status"), "human_category", "human_severity", F.col("feedback_notes").alias("human_feedback"),
        text.first_present(F.col("reviewer_name"), F.lit("anonymous")).alias("reviewed_by"), "reviewed_at")
    order = F.struct("reviewed_at", "action", F.coalesce("reviewer_name", F.lit("")))
    latest = reviews.groupBy(F.col("candidate_id").alias("id")).agg(F.max_by(decision, order).alias("d"))
    joined = candidates.join(latest, "id", "left")
    changed = ["status", "human_category", "human_severity", "human_feedback", "reviewed_by", "reviewed_at"]

    def merged(name: str) -> Column:
        old = F.col(name) if name in candidates.columns else F.lit(None)
        return F.when(F.col("d").isNotNull(), F.col(f"d.{name}")).otherwise(old)

    return joined.withColumns({name: merged(name) for name in changed}).drop("d")


# ---------------------------------------------------------------- export shapes


def _final(kind: str) -> Column:
    return text.first_present(F.col(f"human_{kind}"), F.col(f"llm_{kind}"))


def _time_or_null(candidates: DataFrame, name: str) -> Column:
    return text.time_text(F.col(name), "T") if name in candidates.columns else F.lit(None).cast("string")


def export_json(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "id", "dag_id", "task_id", "error_message", "raw_logs", _final("category").alias("category"),
        _final("severity").alias("severity"), F.col("llm_confidence").alias("confidence"), "status", "human_feedback",
        _time_or_null(candidates, "created_at").alias("created_at"),
        _time_or_null(candidates, "reviewed_at").alias("reviewed_at"))


def export_csv(candidates: DataFrame) -> DataFrame:
    """The JSON export without the raw logs; missing values become empty texts."""
    rows = export_json(candidates).drop("raw_logs")
    return rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns])


def export_jsonl(candidates: DataFrame) -> DataFrame:
    return candidates.select(
        "id", F.col("error_message").alias("text"), _final("category").alias("label"),
        F.struct(_final("severity").alias("severity"), "dag_id", "task_id",
                 F.col("llm_confidence").alias("confidence"), "status").alias("metadata"))


def from_log_lines(rows: DataFrame) -> DataFrame:
    """(candidates, error) rows as pending candidates with ids read from the text; rows lacking either are skipped."""
    return rows.filter(text.present(F.col("candidates")) & text.present(F.col("error"))).select(
        F.sha2(F.concat_ws("|", "candidates", "error"), 256).alias("id"),
        extract_id(F.col("candidates"), "DAG_ID").alias("dag_id"),
        extract_id(F.col("candidates"), "TASK_ID").alias("task_id"),
        extract_id(F.col("candidates"), "DAG_RUN_ID").alias("run_id"),
        F.col("error").alias("error_message"), F.col("candidates").alias("raw_logs"), F.lit("pending").alias("status"))

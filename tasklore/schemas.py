"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tasklore.functions import fixed_values as fv

LOG_ENTRY = T.StructType([
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("level", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("dag_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
    T.StructField("try_number", T.IntegerType()),
    T.StructField("line_number", T.IntegerType()),
    T.StructField("raw_content", T.StringType()),
])

LOG_MANIFEST = T.StructType([
    T.StructField("filepath", T.StringType()),
    T.StructField("start_date", T.TimestampNTZType()),
    T.StructField("end_date", T.TimestampNTZType()),
    T.StructField("dag_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("run_id", T.StringType()),
])

_ANALYSIS = T.StructType([
    T.StructField("error_message", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("category", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("reasoning", T.StringType()),
])

FEEDBACK_RECORD = T.StructType([
    T.StructField("log_context", T.StringType()),
    T.StructField("dag_id", T.StringType()),
    T.StructField("task_id", T.StringType()),
    T.StructField("original_analysis", _ANALYSIS),
    T.StructField("corrected_analysis", _ANALYSIS),
    T.StructField("user_rating", T.IntegerType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("comments", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("feedback_id", T.StringType()),
])

CANDIDATE_LINE = T.StructType([
    T.StructField("candidates", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

REVIEWED_ROW = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("raw_logs", T.StringType()),
    T.StructField("human_feedback", T.StringType()),
    T.StructField("status", T.StringType()),
])

TRAINING_EXAMPLE = T.StructType([
    T.StructField("instruction", T.StringType()),
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])

TASK_KEY = ["dag_id", "task_id"]
RUN_KEY = ["dag_id", "task_id", "run_id"]
TRY_KEY = ["dag_id", "task_id", "run_id", "try_number"]


def severity_rank(severity: Column) -> Column:
    """Position in the ordered severity list; unknown names rank 0."""
    return F.array_position(F.array(*[F.lit(s) for s in fv.SEVERITIES]), severity)


def candidate_problems(status: Column, rating: Column, confidence: Column) -> Column:
    """Data-quality check: names of the fields that break their documented range."""
    checks = [
        F.when(~status.isin(*fv.CANDIDATE_STATUSES), "status"),
        F.when(~rating.between(1, 5), "rating"),
        F.when(~confidence.between(0.0, 1.0), "confidence"),
    ]
    return F.array_compact(F.array(*checks))

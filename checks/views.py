"""Canonical input views derived from the given tables, in one text for Spark and DuckDB.

The definitions follow FIXTURES.md; only the dialect differs between the two engines.
"""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tasklore.sources.readers import spread

AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"


class Duck:
    text = "VARCHAR"
    double = "DOUBLE"

    @staticmethod
    def fmt(x: str) -> str:
        return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"

    @staticmethod
    def iso(x: str) -> str:
        return f"strftime({x}, '%Y-%m-%dT%H:%M:%S')"

    @staticmethod
    def add(x: str, seconds: str) -> str:
        return f"{x} + to_seconds(CAST({seconds} AS BIGINT))"

    tries = "task_runs r JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) t ON t.n <= r.try_number"


class Spark:
    text = "STRING"
    double = "DOUBLE"

    @staticmethod
    def fmt(x: str) -> str:
        return f"date_format({x}, 'yyyy-MM-dd HH:mm:ss')"

    @staticmethod
    def iso(x: str) -> str:
        return f"date_format({x}, \"yyyy-MM-dd'T'HH:mm:ss\")"

    @staticmethod
    def add(x: str, seconds: str) -> str:
        return f"{x} + make_dt_interval(0, 0, 0, {seconds})"

    tries = "task_runs r LATERAL VIEW explode(sequence(0, r.try_number)) t AS n"


def definitions(d: type) -> dict[str, str]:
    s, fmt, add = d.text, d.fmt, d.add
    stamp = f"concat('[', {fmt('ts')}, "
    return {
        "task_runs": f"""
SELECT event_id, user_id,
  concat('dag_', CAST(user_id % 10 AS {s})) AS dag_id,
  concat('task_', CAST(CAST(FLOOR(user_id / 10.0) AS BIGINT) % 3 AS {s})) AS task_id,
  concat('run_', CAST(event_id AS {s})) AS run_id,
  CASE WHEN event_type = 'error' THEN 'failed' WHEN event_type = 'signup' OR user_id % 10 = 9 THEN 'running' ELSE 'success' END AS state,
  1 + event_id % 2 AS try_number,
  ts AS start_date,
  {add('ts', 'CAST(FLOOR(value) AS INT)')} AS end_date,
  k, value, err_text,
  concat_ws(chr(10),
    {stamp}'] INFO - Starting attempt ', CAST(1 + event_id % 2 AS {s}), ' of 3'),
    {stamp}CASE WHEN k % 6 = 0 THEN '] WARNING' ELSE '] INFO' END, ' - Host 10.0.0.', CAST(user_id % 250 AS {s}), ' read ', CAST(k AS {s}), ' rows'),
    '   ',
    CASE WHEN event_type <> 'error' AND k % 3 = 0 THEN {stamp}'] ERROR - Query timeout after ', CAST(k AS {s}), ' seconds') END,
    CASE WHEN event_type = 'error' THEN {stamp}'] ERROR - ', err_text)
         ELSE {stamp}'] INFO - Marking task as SUCCESS') END,
    CASE WHEN event_type = 'error' AND event_id % 4 = 0 THEN {stamp}'] ERROR - ', err_text) END,
    CASE WHEN event_type = 'error' AND k % 4 = 1 THEN 'Traceback (most recent call last):' END,
    CASE WHEN event_type = 'error' AND k % 4 = 1 THEN concat('  File "job.py", line ', CAST(k AS {s}), ', in run') END,
    CASE WHEN event_type = 'error' AND k % 5 = 2 THEN {stamp}'] ERROR - Caused by: java.io.IOException code ', CAST(k AS {s})) END,
    CASE WHEN event_type = 'error' THEN '$ Task failed with exception'
         ELSE '[local] Task exited with return code 0' END) AS log_content
FROM (SELECT *, CASE WHEN event_type = 'error' THEN
    CASE event_id % 7
      WHEN 0 THEN concat('Connection refused to database 10.0.0.', CAST(user_id % 250 AS {s}))
      WHEN 1 THEN concat('Query timeout after ', CAST(k AS {s}), ' seconds')
      WHEN 2 THEN concat('File /data/part_', CAST(k AS {s}), '.csv not found')
      WHEN 3 THEN concat('TPT04', CAST(100 + k AS {s}), ': tbuild command line error')
      WHEN 4 THEN 'Deadlock detected, transaction aborted'
      WHEN 5 THEN 'Permission denied for user etl'
      ELSE concat('Unexpected value 0x', CAST(k AS {s}), ' in "column id"') END END AS err_text
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e0) e1""",
        "task_tries": f"""
SELECT r.dag_id, r.task_id, r.run_id, CAST(t.n AS BIGINT) AS try_number,
  CASE WHEN t.n = r.try_number THEN r.state ELSE 'failed' END AS state,
  r.start_date, r.end_date, r.log_content
FROM {d.tries}""",
        "task_fail": "SELECT dag_id, task_id, run_id, start_date, end_date FROM task_runs WHERE state = 'failed'",
        "error_logs": """
SELECT event_id AS id, start_date AS ts, CAST(start_date AS DATE) AS dt, dag_id, task_id, run_id,
  err_text AS error_message, log_content AS log_context, k % 3 = 0 AS resolved
FROM task_runs WHERE state = 'failed'""",
        "ai_analysis": f"""
SELECT 2 * event_id AS id, event_id AS error_log_id, end_date AS analysis_ts,
  CASE WHEN event_id % 17 = 0 THEN '' ELSE err_text END AS extracted_error,
  CASE event_id % 7 WHEN 0 THEN 'dependency_failure' WHEN 1 THEN 'timeout_error' WHEN 2 THEN 'data_quality'
    WHEN 3 THEN 'configuration_error' WHEN 4 THEN 'resource_error' WHEN 5 THEN 'permission_error' ELSE 'unknown' END AS predicted_category,
  CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS predicted_severity,
  CAST(k AS {d.double}) / 100 AS confidence_score, 'v1.0' AS model_version
FROM task_runs WHERE state = 'failed' AND event_id % 5 <> 0
UNION ALL
SELECT 2 * event_id + 1, event_id, end_date, err_text, 'unknown', 'low', CAST(0.5 AS {d.double}), 'v1.1'
FROM task_runs WHERE state = 'failed' AND event_id % 11 = 0""",
        "user_feedback": f"""
SELECT event_id AS id, event_id AS error_log_id,
  CASE WHEN event_id % 5 <> 0 THEN 2 * event_id END AS ai_analysis_id,
  concat('user_', CAST(user_id % 12 AS {s})) AS reviewer,
  {add('end_date', 'k * 60')} AS feedback_ts,
  CASE WHEN event_id % 19 = 0 THEN NULL ELSE err_text END AS corrected_error,
  CASE WHEN k % 10 = 0 THEN NULL WHEN k % 2 = 0 THEN 'resource_error' ELSE 'data_quality' END AS corrected_category,
  CASE WHEN k % 3 = 0 THEN 'high' ELSE 'medium' END AS corrected_severity,
  CASE WHEN k % 7 = 0 THEN NULL ELSE 1 + k % 5 END AS user_rating
FROM task_runs WHERE state = 'failed' AND event_id % 3 = 0""",
        "analysis_records": f"""
SELECT concat('a', CAST(a.id AS {s})) AS id, r.dag_id, r.task_id, r.run_id, r.err_text AS error_message,
  a.predicted_category AS category, a.predicted_severity AS severity, a.confidence_score AS confidence,
  r.value / 100 AS processing_time, r.start_date AS ts, r.event_id % 13 <> 0 AS success
FROM ai_analysis a JOIN task_runs r ON a.error_log_id = r.event_id""",
        "error_candidates": f"""
SELECT concat('c', CAST(event_id AS {s})) AS id, dag_id, task_id, run_id, err_text AS error_message, log_content AS raw_logs,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN 'resource_error' ELSE 'data_quality' END AS llm_category,
  CASE WHEN event_id % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN 'high' ELSE 'medium' END AS llm_severity,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(k AS {d.double}) / 100 END AS llm_confidence,
  CASE WHEN event_id % 4 = 0 OR k % 9 = 0 THEN NULL ELSE 'timeout_error' END AS human_category,
  CASE WHEN event_id % 4 = 0 OR k % 4 = 0 THEN NULL ELSE 'critical' END AS human_severity,
  CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'null' WHEN 2 THEN '  ' ELSE concat(' ', err_text, ' ') END AS human_feedback,
  CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' WHEN 2 THEN 'rejected' ELSE 'modified' END AS status,
  start_date AS created_at, value / 100 AS processing_time
FROM task_runs WHERE state = 'failed'""",
        "eval_pairs": f"""
SELECT event_id AS example_id, concat('Error: ', err_text) AS expected,
  CASE event_id % 4 WHEN 0 THEN upper(err_text) WHEN 1 THEN concat('The error is:  ', err_text, '  ')
    WHEN 2 THEN 'timeout' ELSE concat(err_text, ' on host a') END AS generated,
  CAST(k AS {d.double}) / 50 AS loss, event_id % 7 AS grp
FROM task_runs WHERE state = 'failed'""",
        # Answers a model might give: fenced, bare, malformed, with an unknown label, without some fields.
        "model_answers": f"""
SELECT event_id AS id, err_text,
  CASE k % 7
    WHEN 0 THEN concat('```json', chr(10), '{{"error_message": "', replace(err_text, '"', ''), '", "confidence": 0.', CAST(10 + k AS {s}), ', "category": "timeout_error", "severity": "high", "error_lines": ["x", "y"], "reasoning": "r"}}', chr(10), '```')
    WHEN 1 THEN concat('{{"error_message": "', replace(err_text, '"', ''), '"}}')
    WHEN 2 THEN '{{"category": "no_such_category", "confidence": 0.5}}'
    WHEN 3 THEN concat('not json: ', err_text)
    WHEN 4 THEN concat('```', chr(10), '{{"confidence": 0.4}}', chr(10), '```')
    WHEN 5 THEN '{{"confidence": "high", "severity": "low"}}'
    ELSE '{{"confidence": "0.75", "severity": "critical", "category": "data_quality"}}' END AS answer,
  CASE k % 6 WHEN 0 THEN ' Timeout_Error ' WHEN 1 THEN concat('```text', chr(10), 'data_quality', chr(10), '```')
    WHEN 2 THEN 'resource_error|timeout_error' WHEN 3 THEN 'unknown' WHEN 4 THEN '' ELSE 'PERMISSION_ERROR' END AS category_answer,
  CASE k % 4 WHEN 0 THEN concat('Steps:', chr(10), '1. Check ', err_text, chr(10), '2 Restart', chr(10), 'then wait', chr(10), '- Tell the owner')
    WHEN 1 THEN concat('* Look at line ', CAST(k AS {s}), chr(10), '* ', chr(10), '  10.  Retry')
    WHEN 2 THEN 'nothing to do' ELSE '3.' END AS steps_answer,
  CASE k % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'None' WHEN 2 THEN concat(' ', err_text, ' ') WHEN 3 THEN repeat(concat(err_text, ' '), 8) ELSE 'UNKNOWN' END AS line_answer
FROM task_runs WHERE state = 'failed'""",
        # Reviews: some candidates get two decisions, the later one counts.
        "reviews": f"""
SELECT concat('c', CAST(event_id AS {s})) AS candidate_id,
  CASE k % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'reject' WHEN 2 THEN 'modify' ELSE 'approved' END AS action,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'data_quality' END AS human_category, 'low' AS human_severity,
  concat('note ', CAST(k AS {s})) AS feedback_notes,
  CASE k % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('user_', CAST(user_id % 12 AS {s})) END AS reviewer_name,
  end_date AS reviewed_at
FROM task_runs WHERE state = 'failed' AND k >= 40
UNION ALL
SELECT concat('c', CAST(event_id AS {s})), 'reject', NULL, 'high', 'second look', 'lead', {add('end_date', '3600')}
FROM task_runs WHERE state = 'failed' AND k >= 70""",
    }


def with_clause(target: str, views: dict[str, str], given: str = "") -> str:
    """WITH clause holding the views that ``target`` refers to, directly or through other views."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name, body in views.items():
            if name not in needed and re.search(rf"\b{name}\b", sql):
                visit(body)
                if name not in needed:
                    needed.append(name)

    visit(target)
    parts = ([given] if given else []) + [f"{name} AS ({views[name].strip()})" for name in needed]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


class Views:
    """Spark side: every view is a lazy DataFrame over the given folder (or over a given events frame)."""

    def __init__(self, spark: SparkSession, folder: str, events: DataFrame | None = None):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.folder = spark, folder
        self._events = events

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def heavy(self) -> Views:
        """The same views with the events spread over all cores, for queries that parse logs."""
        return Views(self.spark, self.folder, spread(self.table("events"), "event_id"))

    @property
    def texts(self) -> DataFrame:
        return spread(self.table("documents"), "doc_id", rows_per_task=10_000)

    def view(self, name: str) -> DataFrame:
        views = {k: v.replace("{", "{{").replace("}", "}}") for k, v in definitions(Spark).items()}
        clause = with_clause(f"SELECT * FROM {name}", views, "events AS (SELECT * FROM {events_in})")
        events = self.table("events") if self._events is None else self._events
        return self.spark.sql(f"{clause}SELECT * FROM {name}", events_in=events)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.view(name)

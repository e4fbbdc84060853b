"""Checked queries over history, review queue, feedback, reports and alerts."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql
from checks.catalog_analysis import SUMMARY_SQL, analysed
from checks.registry import check
from checks.views import AS_OF, AS_OF_SQL, Views
from tasklore.operators import alerts, candidates, feedback, reports
from tasklore.plans import monitoring
from tasklore.session import scratch_path
from tasklore.sources import readers, writers
from tasklore.sources.keyed_store import KeyedStore

DAY = date(2024, 1, 25)
DAY_SQL = "DATE '2024-01-25'"


def flat_map(column: str):
    """Map as sorted ``key=value`` text, so both engines can be compared."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def flat_top(column: str):
    return F.array_join(F.transform(column, lambda e: F.concat(e["dag_id"], F.lit("="), e["failures"].cast("string"))), ",")


def counts_sql(source: str, name: str) -> str:
    return f"(SELECT string_agg({name} || '=' || n, ',' ORDER BY {name}) FROM (SELECT {name}, count(*) AS n FROM {source} GROUP BY 1) c WHERE {name} IS NOT NULL)"


def top_sql(source: str, k: int = 5) -> str:
    return (f"(SELECT string_agg(dag_id || '=' || n, ',' ORDER BY n DESC, dag_id) FROM (SELECT dag_id, count(*) AS n FROM {source} "
            f"GROUP BY 1 ORDER BY n DESC, dag_id LIMIT {k}) t)")


# ---------------------------------------------------------------- history and review queue


@check("f15_history_filter", """
SELECT id, dag_id, task_id, run_id, CASE WHEN length(error_message) > 100 THEN substr(error_message, 1, 100) || '...' ELSE error_message END AS error_message,
  category, severity, confidence, processing_time, ts, success FROM analysis_records
WHERE dag_id = 'dag_4' AND task_id = 'task_1' ORDER BY ts DESC, id LIMIT 50""")
def f15(v: Views) -> DataFrame:
    return candidates.history(v.analysis_records, "dag_4", "task_1")


_QUEUE = "id, dag_id, task_id, run_id, error_message, llm_category, llm_severity, human_category, human_severity, status, created_at"


@check("f16_candidate_filter", f"""
SELECT {_QUEUE} FROM error_candidates WHERE status = 'approved' AND (llm_category = 'timeout_error' OR human_category = 'timeout_error')
  AND (llm_severity = 'high' OR human_severity = 'high') ORDER BY created_at DESC, id LIMIT 50 OFFSET 20""")
def f16(v: Views) -> DataFrame:
    return candidates.queue(v.error_candidates, "approved", "timeout_error", "high", 50, 20).select(*_QUEUE.split(", "))


@check("f17_export_filter", f"""
SELECT {_QUEUE}, llm_confidence FROM error_candidates WHERE status <> 'rejected' AND llm_confidence >= 0.3
  AND (human_category IN ('timeout_error', 'data_quality') OR (human_category IS NULL AND llm_category IN ('timeout_error', 'data_quality')))
  AND (human_severity IN ('critical', 'high') OR (human_severity IS NULL AND llm_severity IN ('critical', 'high')))""")
def f17(v: Views) -> DataFrame:
    chosen = candidates.export_selection(v.error_candidates, False, ["timeout_error", "data_quality"], ["critical", "high"], 0.3)
    return chosen.select(*_QUEUE.split(", "), "llm_confidence")


_REVIEWED = f"human_feedback IS NOT NULL AND human_feedback <> 'null' AND {sql.strip('human_feedback')} <> '' AND status IN ('approved', 'modify', 'modified')"


@check("f18_reviewed_filter", f"SELECT id, human_feedback, status FROM error_candidates WHERE {_REVIEWED}")
def f18(v: Views) -> DataFrame:
    return candidates.reviewed(v.error_candidates).select("id", "human_feedback", "status")


@check("f19_user_feedback", """
SELECT id, reviewer, feedback_ts, user_rating, (SELECT count(*) FROM user_feedback WHERE reviewer = 'user_3') AS feedback_count
FROM user_feedback WHERE reviewer = 'user_3'""")
def f19(v: Views) -> DataFrame:
    return feedback.user_feedback(v.user_feedback, "user_3").select("id", "reviewer", "feedback_ts", "user_rating", "feedback_count")


@check("f20_feedback_by_date", f"SELECT id, reviewer, feedback_ts FROM user_feedback WHERE CAST(feedback_ts AS DATE) = {DAY_SQL}")
def f20(v: Views) -> DataFrame:
    return feedback.feedback_on(v.user_feedback, DAY).select("id", "reviewer", "feedback_ts")


@check("g13_candidate_stats", """
SELECT count(*) AS total_candidates, count_if(status = 'pending') AS pending_review, count_if(status = 'approved') AS approved,
  count_if(status = 'rejected') AS rejected, count_if(status = 'modified') AS modified,
  count_if(status IN ('approved', 'modified')) / count_if(status IN ('approved', 'modified', 'rejected'))::DOUBLE AS accuracy_rate,
  floor(avg(llm_confidence) * 1e6 + 0.5) / 1e6 AS avg_confidence FROM error_candidates""")
def g13(v: Views) -> DataFrame:
    return candidates.statistics(v.error_candidates).withColumn("avg_confidence", F.floor(F.col("avg_confidence") * 1e6 + 0.5) / 1e6)


@check("g18_pending_remaining", """
SELECT id, created_at, greatest((SELECT count(*) FROM error_candidates WHERE status = 'pending' AND llm_category IS NULL) - 50, 0) AS remaining_pending
FROM error_candidates WHERE status = 'pending' AND llm_category IS NULL ORDER BY created_at DESC, id LIMIT 50""")
def g18(v: Views) -> DataFrame:
    return candidates.next_to_label(v.error_candidates).select("id", "created_at", "remaining_pending")


_ISO = "strftime(created_at, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(created_at, '%f') = '000000' THEN '' ELSE '.' || strftime(created_at, '%f') END"
_FINAL = "coalesce(human_category, llm_category) AS category, coalesce(human_severity, llm_severity) AS severity"


@check("k04_export_json", f"""
SELECT id, dag_id, task_id, error_message, raw_logs, {_FINAL}, llm_confidence AS confidence, status, human_feedback,
  {_ISO} AS created_at, NULL AS reviewed_at FROM error_candidates""")
def k04(v: Views) -> DataFrame:
    rows, path = candidates.export_json(v.error_candidates), scratch_path(v.spark, "export-json")
    writers.write_json_arrays(rows, path, "id", rows_per_document=500)
    return readers.json_arrays(v.spark, path, rows.schema)


@check("k05_export_csv", f"""
SELECT id, dag_id, task_id, error_message, coalesce(category, '') AS category, coalesce(severity, '') AS severity,
  coalesce(CAST(llm_confidence AS VARCHAR), '') AS confidence, status, coalesce(human_feedback, '') AS human_feedback,
  created, '' AS reviewed_at FROM (SELECT id, dag_id, task_id, error_message, {_FINAL}, llm_confidence, status, human_feedback, {_ISO} AS created FROM error_candidates) e""")
def k05(v: Views) -> DataFrame:
    rows, path = candidates.export_csv(v.error_candidates), scratch_path(v.spark, "export-csv")
    writers.write_csv(rows, path)
    return readers.csv_export(v.spark, path, rows.schema).withColumnRenamed("created_at", "created")


@check("k06_export_jsonl", """
SELECT id, error_message AS text, coalesce(human_category, llm_category) AS label, coalesce(human_severity, llm_severity) AS severity,
  dag_id, task_id, llm_confidence AS confidence, status FROM error_candidates""")
def k06(v: Views) -> DataFrame:
    rows, path = candidates.export_jsonl(v.error_candidates), scratch_path(v.spark, "export-jsonl")
    writers.write_json(rows, path)
    return v.spark.read.schema(rows.schema).json(path).select("id", "text", "label", "metadata.*")


@check("k09_bulk_candidates", f"""
SELECT sha256(id || '|' || dag_id || '|' || task_id || '|' || run_id) AS id, dag_id, task_id, run_id, coalesce(error_message, '') AS error_message,
  '' AS raw_logs, category AS llm_category, severity AS llm_severity, confidence AS llm_confidence, 'pending' AS status,
  {AS_OF_SQL} AS created_at, processing_time FROM analysis_records""")
def k09(v: Views) -> DataFrame:
    rows = candidates.from_analyses(v.analysis_records, AS_OF)
    queue = KeyedStore(v.spark, scratch_path(v.spark, "candidates"), rows.schema, ["id"])
    queue.apply(rows, 0)
    queue.apply(rows, 0)  # delivered again: nothing is added
    return queue.read().drop("llm_reasoning")


@check("n06_review_apply", """
WITH latest AS (SELECT candidate_id, max_by(r, reviewed_at) AS d FROM reviews r GROUP BY candidate_id)
SELECT c.id, CASE WHEN d IS NULL THEN c.status ELSE CASE d.action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected'
    WHEN 'modify' THEN 'modified' ELSE d.action END END AS status,
  CASE WHEN d IS NULL THEN c.human_category ELSE d.human_category END AS human_category,
  CASE WHEN d IS NULL THEN c.human_severity ELSE d.human_severity END AS human_severity,
  CASE WHEN d IS NULL THEN c.human_feedback ELSE d.feedback_notes END AS human_feedback,
  CASE WHEN d IS NOT NULL THEN coalesce(nullif(d.reviewer_name, ''), 'anonymous') END AS reviewed_by, d.reviewed_at AS reviewed_at
FROM error_candidates c LEFT JOIN latest l ON l.candidate_id = c.id""")
def n06(v: Views) -> DataFrame:
    return candidates.apply_reviews(v.error_candidates, v.reviews).select(
        "id", "status", "human_category", "human_severity", "human_feedback", "reviewed_by", "reviewed_at")


# ---------------------------------------------------------------- joins over feedback tables


@check("j01_daily_errors", f"""
SELECT e.*, a.extracted_error, a.predicted_category, a.predicted_severity, a.confidence_score,
  f.corrected_error, f.corrected_category, f.corrected_severity, f.user_rating,
  coalesce(a.extracted_error <> '', false) AS has_analysis, coalesce(f.corrected_error <> '', false) AS has_feedback
FROM error_logs e LEFT JOIN ai_analysis a ON e.id = a.error_log_id LEFT JOIN user_feedback f ON e.id = f.error_log_id
WHERE e.dt = {DAY_SQL}""")
def j01(v: Views) -> DataFrame:
    return feedback.daily_errors(v.error_logs, v.ai_analysis, v.user_feedback, DAY)


def _todo(join: str, limit: str) -> str:
    return f"""
SELECT e.*, a.id AS analysis_id, a.extracted_error, a.predicted_category, a.predicted_severity, a.confidence_score
FROM error_logs e {join} JOIN ai_analysis a ON e.id = a.error_log_id LEFT JOIN user_feedback f ON e.id = f.error_log_id
WHERE e.dt >= DATE '2024-01-24' AND f.id IS NULL ORDER BY e.ts DESC, e.id, a.id NULLS FIRST {limit}"""


@check("j02_feedback_todo", _todo("INNER", "LIMIT 50"))
def j02(v: Views) -> DataFrame:
    return feedback.feedback_todo(v.error_logs, v.ai_analysis, v.user_feedback, AS_OF)


@check("j03_feedback_todo_all", _todo("LEFT", ""))
def j03(v: Views) -> DataFrame:
    return feedback.feedback_todo(v.error_logs, v.ai_analysis, v.user_feedback, AS_OF, require_analysis=False, limit=None)


@check("j04_training_rows", """
SELECT f.id, e.log_context, e.error_message, e.dag_id, e.task_id, a.extracted_error AS original_analysis, f.corrected_error,
  f.corrected_category, f.corrected_severity, f.user_rating, f.feedback_ts
FROM user_feedback f JOIN error_logs e ON f.error_log_id = e.id LEFT JOIN ai_analysis a ON f.ai_analysis_id = a.id WHERE f.user_rating >= 3""")
def j04(v: Views) -> DataFrame:
    return feedback.training_rows(v.error_logs, v.ai_analysis, v.user_feedback)


@check("j05_unanalysed", """
SELECT e.dag_id, e.task_id, count(*) AS error_count FROM error_logs e LEFT JOIN ai_analysis a ON e.id = a.error_log_id
WHERE a.id IS NULL GROUP BY ALL""")
def j05(v: Views) -> DataFrame:
    return feedback.unanalysed(v.error_logs, v.ai_analysis)


_PATTERNS = {r"dag_[0-3]\.task_0": ["+100", "+101"], r"dag_2": ["+200"], r"ag_5": ["+never"], r".*task_1$": ["+300", "+301", "+302"]}
_DEFAULT = ["+900"]
_RECIPIENTS = """CASE WHEN regexp_matches(key, '^(?:dag_[0-3]\\.task_0)') THEN ['+100', '+101'] WHEN regexp_matches(key, '^(?:dag_2)') THEN ['+200']
  WHEN regexp_matches(key, '^(?:ag_5)') THEN ['+never'] WHEN regexp_matches(key, '^(?:.*task_1$)') THEN ['+300', '+301', '+302'] ELSE ['+900'] END"""


@check("j07_recipient_join", f"SELECT run_id, array_to_string({_RECIPIENTS}, ',') AS recipients FROM (SELECT run_id, dag_id || '.' || task_id AS key FROM task_fail) t")
def j07(v: Views) -> DataFrame:
    return v.task_fail.select("run_id", F.array_join(alerts.recipients(alerts.task_key(), _PATTERNS, _DEFAULT), ",").alias("recipients"))


@check("j07_pattern_table", """
SELECT run_id, CASE WHEN dag_id = 'dag_1' THEN 'lead' WHEN event_id % 2 = 0 THEN 'user_' || user_id ELSE 'desk' END AS recipients FROM task_runs WHERE state = 'failed'""")
def j07_table(v: Views) -> DataFrame:
    """One pattern for every second run, and one that comes before them all."""
    runs = v.heavy.task_runs
    own = runs.filter("event_id % 2 = 0").select(
        F.col("event_id").alias("position"), F.concat("dag_id", F.lit(r"\.task_[0-9]\."), "run_id", F.lit("$")).alias("pattern"),
        F.array(F.concat(F.lit("user_"), F.col("user_id").cast("string"))).alias("recipients"))
    first = v.spark.sql(r"SELECT -1L AS position, 'dag_1[.].+' AS pattern, array('lead') AS recipients")
    failed = runs.filter("state = 'failed'").select("run_id", F.concat_ws(".", "dag_id", "task_id", "run_id").alias("task_key"))
    return alerts.table_recipients(failed, own.unionByName(first), ["desk"]).select("run_id", F.array_join("recipients", ",").alias("recipients"))


@check("j08_error_listing", """
SELECT e.id, e.dt, e.dag_id, e.task_id, coalesce(a.category, 'Unknown') AS category, a.category IS NOT NULL AS has_analysis,
  EXISTS (SELECT 1 FROM user_feedback f WHERE f.error_log_id = e.id) AS has_feedback
FROM error_logs e LEFT JOIN (SELECT error_log_id, min(predicted_category) AS category FROM ai_analysis GROUP BY 1) a ON a.error_log_id = e.id
WHERE e.dt >= DATE '2024-01-01' AND NOT EXISTS (SELECT 1 FROM user_feedback f WHERE f.error_log_id = e.id) AND coalesce(a.category, 'Unknown') = 'timeout_error'""")
def j08(v: Views) -> DataFrame:
    return feedback.error_listing(v.error_logs, v.ai_analysis, v.user_feedback, AS_OF, days=30, category="timeout_error", show_feedback=False)


# ---------------------------------------------------------------- reports


def _six(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def six(frame: DataFrame, *names: str) -> DataFrame:
    """Averages to six digits: engines add floating-point numbers in different orders."""
    return frame.withColumns({n: F.floor(F.col(n) * 1e6 + 0.5) / 1e6 for n in names})


@check("g01_daily_stats", f"""
SELECT CAST(ts AS DATE) AS date, count(*) AS total_failures, count_if(severity = 'critical') AS critical_failures,
  count_if(severity = 'high') AS high_failures, count_if(severity = 'medium') AS medium_failures, count_if(severity = 'low') AS low_failures,
  {_six('avg(processing_time)')} AS avg_processing_time, {_six('avg(confidence)')} AS avg_confidence
FROM analysis_records WHERE success GROUP BY 1""")
def g01(v: Views) -> DataFrame:
    return six(reports.daily_stats(v.analysis_records), "avg_processing_time", "avg_confidence")


@check("g02_dag_stats", f"""
SELECT dag_id, count(*) AS total_failures, count(DISTINCT task_id) AS affected_tasks, {_six('avg(processing_time)')} AS avg_processing_time,
  max(ts) AS last_failure, count_if(severity IN ('critical', 'high')) AS severe_failures FROM analysis_records WHERE success GROUP BY 1""")
def g02(v: Views) -> DataFrame:
    return six(reports.dag_stats(v.analysis_records), "avg_processing_time")


_TODAY = f"(SELECT * FROM analysis_records WHERE success AND CAST(ts AS DATE) = {DAY_SQL})"


@check("g03_daily_summary", f"""
SELECT {DAY_SQL} AS date, (SELECT count(*) FROM {_TODAY} t) AS total_failures, {counts_sql(_TODAY, 'category')} AS categories,
  {top_sql(_TODAY)} AS top_failing_dags, (SELECT {_six('avg(processing_time)')} FROM {_TODAY} t) AS average_processing_time""")
def g03(v: Views) -> DataFrame:
    summary = six(reports.daily_summary(v.analysis_records, DAY), "average_processing_time")
    return summary.withColumns({"categories": flat_map("categories"), "top_failing_dags": flat_top("top_failing_dags")})


_RECENT = f"(SELECT * FROM analysis_records WHERE ts >= {AS_OF_SQL} - INTERVAL 30 DAY)"


@check("g04_dashboard_stats", f"""
SELECT count(*) AS total_failures, count_if(ts >= {AS_OF_SQL} - INTERVAL 1 DAY) AS today_failures, {_six('avg(processing_time)')} AS average_processing_time,
  (SELECT count_if(resolved) / count(*)::DOUBLE FROM error_logs WHERE ts >= {AS_OF_SQL} - INTERVAL 30 DAY) AS resolution_rate,
  {counts_sql(_RECENT, 'category')} AS error_categories, {top_sql(_RECENT)} AS top_failing_dags, 30 AS period_days FROM {_RECENT} r""")
def g04(v: Views) -> DataFrame:
    stats = six(reports.dashboard_stats(v.analysis_records, v.error_logs, AS_OF, days=30), "average_processing_time")
    return stats.withColumns({"error_categories": flat_map("error_categories"), "top_failing_dags": flat_top("top_failing_dags")})


@check("g05_trends", """
SELECT CAST(d.date AS DATE) AS date, count(e.id) AS failures, count_if(coalesce(e.resolved, false)) AS resolved
FROM (SELECT unnest(generate_series(DATE '2023-12-27', DATE '2024-01-30', INTERVAL 1 DAY)) AS date) d
LEFT JOIN error_logs e ON e.dt = CAST(d.date AS DATE) GROUP BY 1""")
def g05(v: Views) -> DataFrame:
    return reports.trends(v.error_logs, AS_OF, days=35)


@check("g06_recent_failures", """
SELECT id, dag_id, task_id, run_id, ts, error_message, category, severity FROM analysis_records ORDER BY ts DESC, id LIMIT 10""")
def g06(v: Views) -> DataFrame:
    return reports.recent_failures(v.analysis_records)


@check("g07_timeline", f"SELECT id, ts, dag_id, task_id, severity, category FROM analysis_records WHERE ts >= {AS_OF_SQL} - INTERVAL 168 HOUR")
def g07(v: Views) -> DataFrame:
    return reports.timeline(v.analysis_records, AS_OF, hours=168)


@check("g08_health", f"""
SELECT CAST(floor(score) AS INTEGER) AS health_score, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'warning' ELSE 'critical' END AS status,
  recent AS recent_failures, CASE WHEN recent < week / 7.0::DOUBLE THEN 'improving' WHEN recent = week / 7.0::DOUBLE THEN 'stable' ELSE 'degrading' END AS trend
FROM (SELECT *, CASE WHEN week = 0 THEN 100.0::DOUBLE ELSE greatest(0.0::DOUBLE, 100 - recent / (week / 7.0::DOUBLE) * 20) END AS score
  FROM (SELECT count_if(ts >= {AS_OF_SQL} - INTERVAL 1 DAY) AS recent, count(*) AS week FROM analysis_records WHERE ts >= {AS_OF_SQL} - INTERVAL 7 DAY) c) s""")
def g08(v: Views) -> DataFrame:
    return reports.health(v.analysis_records, AS_OF)


@check("g09_feedback_stats", f"""
SELECT count_if(feedback_ts >= DATE '2024-01-11') AS total_feedback_count,
  coalesce({sql.half_up("avg(user_rating) FILTER (feedback_ts >= DATE '2024-01-11')", 2)}, 0) AS avg_user_rating,
  count_if(feedback_ts >= DATE '2024-01-24') AS recent_feedback_count,
  {counts_sql("(SELECT * FROM user_feedback WHERE feedback_ts >= DATE '2024-01-11')", 'corrected_category')} AS category_distribution FROM user_feedback""")
def g09(v: Views) -> DataFrame:
    return feedback.feedback_stats(v.user_feedback, AS_OF, days=20).withColumn("category_distribution", flat_map("category_distribution"))


@check("g10_feedback_stats_jsonl", f"""
SELECT count(*) AS total_feedback_count, {sql.half_up('sum(user_rating) / count(*)::DOUBLE', 2)} AS avg_user_rating,
  count_if(feedback_ts > {AS_OF_SQL} - INTERVAL 7 DAY) AS recent_feedback_count, {counts_sql('user_feedback', 'corrected_category')} AS category_distribution
FROM user_feedback""")
def g10(v: Views) -> DataFrame:
    return feedback.feedback_stats_all(v.user_feedback, AS_OF).withColumn("category_distribution", flat_map("category_distribution"))


@check("g11_category_share", f"""
SELECT corrected_category, count(*) AS n, {sql.half_up('count(*) / (SELECT count(*) FROM user_feedback WHERE corrected_category IS NOT NULL)::DOUBLE * 100', 1)} AS percent
FROM user_feedback WHERE corrected_category IS NOT NULL GROUP BY 1""")
def g11(v: Views) -> DataFrame:
    return feedback.category_share(v.user_feedback)


@check("g12_progress", f"""
SELECT total_errors, analyzed_errors, feedback_errors, quality_feedback, {sql.half_up('analyzed_errors / total_errors::DOUBLE * 100', 1)} AS analysis_rate,
  {sql.half_up('feedback_errors / total_errors::DOUBLE * 100', 1)} AS feedback_rate
FROM (SELECT (SELECT count(*) FROM error_logs) AS total_errors, (SELECT count(DISTINCT error_log_id) FROM ai_analysis) AS analyzed_errors,
  (SELECT count(DISTINCT error_log_id) FROM user_feedback) AS feedback_errors, (SELECT count_if(user_rating >= 3) FROM user_feedback) AS quality_feedback) c""")
def g12(v: Views) -> DataFrame:
    return feedback.progress(v.error_logs, v.ai_analysis, v.user_feedback)


@check("g14_top_categories", "SELECT corrected_category, count(*) AS n FROM user_feedback WHERE feedback_ts >= DATE '2024-01-05' GROUP BY 1")
def g14(v: Views) -> DataFrame:
    return feedback.top_categories(v.user_feedback, datetime(2024, 1, 5))


@check("g15_monitor_stats", f"""
SELECT count(*) AS processed, count(DISTINCT run_id) AS failed_tasks_found, {_six('sum(processing_time)')} AS total_processing_time,
  {_six('sum(processing_time) / count(*)')} AS average_processing_time, max(ts) AS last_check FROM analysis_records""")
def g15(v: Views) -> DataFrame:
    return six(reports.monitor_stats(v.analysis_records), "total_processing_time", "average_processing_time")


@check("g16_recent_feedback", """
SELECT id, reviewer, feedback_ts, user_rating, (SELECT count(*) FROM user_feedback) AS total_count FROM user_feedback ORDER BY feedback_ts DESC, id LIMIT 10""")
def g16(v: Views) -> DataFrame:
    return feedback.recent_feedback(v.user_feedback).select("id", "reviewer", "feedback_ts", "user_rating", "total_count")


@check("g17_auto_export", """
SELECT n AS recent_feedback_count, n >= 50 AS export_due FROM (SELECT count(*) AS n FROM user_feedback WHERE feedback_ts >= DATE '2024-01-24') c""")
def g17(v: Views) -> DataFrame:
    return feedback.auto_export_due(v.user_feedback, AS_OF)


@check("g19_retention", """
SELECT 'errors' AS part, count_if(dt < DATE '2024-01-16') AS deleted, count_if(dt >= DATE '2024-01-16') AS kept FROM error_logs
UNION ALL SELECT 'analyses', count_if(e.dt < DATE '2024-01-16'), count_if(e.dt >= DATE '2024-01-16') FROM ai_analysis a JOIN error_logs e ON e.id = a.error_log_id
UNION ALL SELECT 'feedback', count_if(e.dt < DATE '2024-01-16'), count_if(e.dt >= DATE '2024-01-16') FROM user_feedback a JOIN error_logs e ON e.id = a.error_log_id""")
def g19(v: Views) -> DataFrame:
    kept = feedback.retain_errors(v.error_logs, AS_OF, 15)
    report = feedback.retention_report(v.error_logs, AS_OF, 15).select(F.lit("errors").alias("part"), "deleted", "kept")
    for name, children in (("analyses", v.ai_analysis), ("feedback", v.user_feedback)):
        rest = feedback.retain_children(children, kept).agg(F.count("*").alias("kept"))
        total = children.agg(F.count("*")).scalar()
        report = report.unionByName(rest.select(F.lit(name).alias("part"), (total - F.col("kept")).alias("deleted"), "kept"))
    return report


# ---------------------------------------------------------------- alerts


@check("n01_alert_select", "SELECT id, dag_id, task_id, severity FROM analysis_records WHERE severity IN ('high', 'critical')")
def n01(v: Views) -> DataFrame:
    return alerts.alert_results(v.analysis_records).select("id", "dag_id", "task_id", "severity")


@check("n02_recipients", f"""
SELECT id, severity, unnest({_RECIPIENTS}) AS recipient FROM (SELECT *, dag_id || '.' || task_id AS key FROM analysis_records) r""")
def n02(v: Views) -> DataFrame:
    return alerts.with_recipients(v.analysis_records, _PATTERNS, _DEFAULT).select("id", "severity", "recipient")


@check("n02_notify_failures", f"""
SELECT dag_id, task_id, run_id, try_number, summary, unnest({_RECIPIENTS}) AS recipient FROM (SELECT *, dag_id || '.' || task_id AS key FROM ({SUMMARY_SQL}) s1) s2""")
def n02_notify(v: Views) -> DataFrame:
    return monitoring.notifications(analysed(v), _PATTERNS, _DEFAULT)


@check("n03_sms_text", """
SELECT id, substr('Pipeline Alert: ' || dag_id || '.' || task_id || ' failed. Error: ' || substr(error_message, 1, 100) || '... Severity: ' || severity, 1, 160) AS sms
FROM analysis_records""")
def n03(v: Views) -> DataFrame:
    return v.analysis_records.select("id", alerts.sms_text(F.col("error_message"), F.col("severity"), "Pipeline Alert").alias("sms"))


def _p(name: str, x: str) -> str:
    return f"'<p><strong>{name}:</strong> ' || {x} || '</p>' || chr(10)"


@check("n04_email_text", f"""
SELECT id, '<html>' || chr(10) || '<body>' || chr(10) || '<h2>Pipeline Alert</h2>' || chr(10) || {_p('Task', "dag_id || '.' || task_id")} || {_p('Run ID', 'run_id')}
  || {_p('Error', 'error_message')} || {_p('Category', 'category')} || {_p('Severity', 'severity')} || {_p('Confidence', "printf('%.1f%%', confidence * 100)")}
  || '<h3>Suggested Actions:</h3>' || chr(10) || '<ul><li>Check ' || category || '</li><li>Retry</li></ul>' || chr(10)
  || '<p><em>Generated at ' || strftime(ts, '%Y-%m-%d %H:%M') || '</em></p>' || chr(10) || '</body>' || chr(10) || '</html>' AS body FROM analysis_records""")
def n04(v: Views) -> DataFrame:
    actions = F.array(F.concat(F.lit("Check "), "category"), F.lit("Retry"))
    body = alerts.email_text(F.col("error_message"), F.col("category"), F.col("severity"), F.col("confidence"), actions,
                             F.date_format("ts", "yyyy-MM-dd HH:mm"), "Pipeline Alert")
    return v.analysis_records.select("id", body.alias("body"))


@check("n07_update_events", f"""
SELECT 'new_failure' AS event_type, dag_id, task_id, run_id, ts AS timestamp, error_message, NULL AS analysis_id, NULL AS processed, {_ISO.replace('created_at', 'ts')} AS payload_time FROM error_logs
UNION ALL SELECT 'analysis_complete', dag_id, task_id, run_id, ts, error_message, id, NULL, NULL FROM analysis_records
UNION ALL SELECT 'status_change', NULL, NULL, NULL, {AS_OF_SQL}, NULL, NULL, CAST(count(*) AS VARCHAR), '2024-01-31T00:00:00' FROM analysis_records""")
def n07(v: Views) -> DataFrame:
    failures = alerts.new_failures(v.error_logs.withColumn("severity", F.lit(None).cast("string")))
    changes = alerts.status_changes(reports.monitor_stats(v.analysis_records), F.lit(AS_OF).cast("timestamp_ntz"))
    events = failures.unionByName(alerts.completed_analyses(v.analysis_records)).unionByName(changes)
    return events.select("event_type", "dag_id", "task_id", "run_id", "timestamp",
                         F.get_json_object("data", "$.error_message").alias("error_message"),
                         F.get_json_object("data", "$.analysis_id").alias("analysis_id"),
                         F.get_json_object("data", "$.monitor_status.processed").alias("processed"),
                         F.get_json_object("data", "$.timestamp").alias("payload_time"))



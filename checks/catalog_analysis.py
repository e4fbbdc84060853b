"""Checked queries over baselines, novelty, error extraction and answer parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql
from checks.registry import check
from checks.views import AS_OF, AS_OF_SQL, Views
from tasklore.functions import answers, prompts, rules, scoring
from tasklore.functions import fixed_values as fv
from tasklore.operators import baseline, logs, novelty, tasks
from tasklore.operators import extension
from tasklore.plans import failure_analysis as plan
from tasklore.plans import monitoring
from tasklore.schemas import TASK_KEY, TRY_KEY

TRY = "dag_id, task_id, run_id, try_number"
WHOLE_PERIOD = 60 * 24 * 60  # minutes; the look-back covers every run of the tables


def learnt(v: Views) -> DataFrame:
    return baseline.shape_baseline(baseline.baseline_lines(v.task_runs, v.heavy.task_runs), AS_OF)


def learnt_tree(v: Views) -> DataFrame:
    return baseline.tree_baseline(baseline.baseline_lines(v.task_runs, v.heavy.task_runs), AS_OF)


def stored(v: Views) -> DataFrame:
    """Baselines of different ages: each is moved back by a number of days taken from its runs."""
    ages = tasks.recent_successes(v.task_runs).select("run_id").join(v.task_runs, "run_id").groupBy(*TASK_KEY).agg(
        (F.max("end_date") - F.make_dt_interval(F.pmod(F.sum("k"), F.lit(40)).cast("int"))).alias("moment"))
    return learnt(v).drop("created_at", "last_updated").join(ages, TASK_KEY).withColumns(
        {"created_at": F.col("moment"), "last_updated": F.col("moment")}).drop("moment")


def failed_texts(v: Views) -> DataFrame:
    return tasks.run_logs(v.task_fail, v.task_tries, v.heavy.task_tries)


def compared(v: Views, exact: bool = False) -> DataFrame:
    known = learnt_tree(v) if exact else learnt(v)
    return plan.compare(plan.candidates_per_try(failed_texts(v), known, rules.preset("notification"), exact=exact))


def analysed(v: Views) -> DataFrame:
    return plan.analyse(compared(v))


def entry_query(v: Views) -> DataFrame:
    result = plan.analyze_tries(v.task_runs, v.task_tries, v.heavy.task_tries, AS_OF, minutes_back=WHOLE_PERIOD)
    return monitoring.flat_results(result)


# ---------------------------------------------------------------- baselines


@check("c03_template_mine")
def c03(v: Views) -> DataFrame:
    return learnt_tree(v).select(*TASK_KEY, "cluster_no", "template", "size")


@check("c05_baseline_table", f"""
SELECT dag_id || '.' || task_id || '_cluster_' || cluster_no AS cluster_id, dag_id, task_id, cluster_no, template, size,
  {AS_OF_SQL} AS created_at, {AS_OF_SQL} AS last_updated FROM base_templates""")
def c05(v: Views) -> DataFrame:
    return learnt(v)


@check("c06_baseline_size", "SELECT dag_id, task_id, cluster_count FROM base_state")
def c06(v: Views) -> DataFrame:
    return baseline.baseline_state(v.task_runs, stored(v), AS_OF).select(*TASK_KEY, "cluster_count")


@check("c07_baseline_age", "SELECT dag_id, task_id, age_days FROM base_state")
def c07(v: Views) -> DataFrame:
    return baseline.baseline_state(v.task_runs, stored(v), AS_OF).select(*TASK_KEY, "age_days")


@check("c08_baseline_stale", "SELECT dag_id, task_id, is_stale FROM base_state")
def c08(v: Views) -> DataFrame:
    return baseline.baseline_state(v.task_runs, stored(v), AS_OF).select(*TASK_KEY, "is_stale")


@check("c09_baseline_refresh", f"""
SELECT s.dag_id, s.task_id, s.template, s.size, CASE WHEN t.is_stale THEN {AS_OF_SQL} ELSE s.last_updated END AS last_updated
FROM base_stored s JOIN base_state t ON t.dag_id = s.dag_id AND t.task_id = s.task_id""")
def c09(v: Views) -> DataFrame:
    heavy = v.heavy.task_runs
    rebuilt = baseline.refresh_stale(v.task_runs, stored(v), lambda stale: baseline.shape_baseline(baseline.baseline_lines(stale, heavy), AS_OF), AS_OF)
    return rebuilt.select(*TASK_KEY, "template", "size", "last_updated")


@check("c10_anomalous_lines", f"SELECT {TRY}, line_number, level, message FROM fail_marked WHERE anomalous")
def c10(v: Views) -> DataFrame:
    found = novelty.shape_novelty(failed_texts(v), learnt(v))
    return novelty.novel_lines(found).select(*TRY_KEY, "line_number", "level", "message")


@check("c10_anomalous_lines_tree")
def c10_tree(v: Views) -> DataFrame:
    found = novelty.tree_novelty(failed_texts(v), learnt_tree(v))
    return novelty.novel_lines(found).select(*TRY_KEY, "line_number", "level", "message")


@check("c11_novelty", f"""
SELECT {TRY}, n_lines, n_anomalous, n_candidates, coalesce(n_anomalous / nullif(n_lines, 0)::DOUBLE, 0.0) AS novelty_score,
  n_lines > 0 AND n_candidates = 0 AS is_known_pattern FROM fail_stats""")
def c11(v: Views) -> DataFrame:
    return compared(v).select(*TRY_KEY, "n_lines", "n_anomalous", "n_candidates", "novelty_score", "is_known_pattern")


@check("c11_novelty_tree")
def c11_tree(v: Views) -> DataFrame:
    return compared(v, exact=True).select(*TRY_KEY, "n_lines", "n_anomalous", "n_candidates", "novelty_score", "is_known_pattern")


@check("c12_baseline_list", """
SELECT s.dag_id, s.task_id, s.cluster_count, s.created_at, s.last_updated, s.is_stale, coalesce(r.n, 0) AS successful_runs
FROM base_state s LEFT JOIN (SELECT dag_id, task_id, count(*) AS n FROM base_runs GROUP BY ALL) r
  ON r.dag_id = s.dag_id AND r.task_id = s.task_id WHERE s.cluster_count > 0""")
def c12(v: Views) -> DataFrame:
    return baseline.listing(v.task_runs, stored(v), AS_OF)


@check("c13_baseline_stats", """
SELECT count(*) AS total_baselines, avg(age_days) AS average_age_days, max(age_days) AS oldest_baseline_days,
  min(age_days) AS newest_baseline_days, count_if(age_days < 3.5) AS fresh,
  count_if(age_days >= 3.5 AND age_days < 7) AS moderate, count_if(age_days >= 7) AS stale
FROM base_state WHERE cluster_count > 0""")
def c13(v: Views) -> DataFrame:
    return baseline.statistics(stored(v), AS_OF)


@check("c14_baseline_retire", f"SELECT b.dag_id, b.task_id, b.template, b.size FROM base_stored b WHERE {sql.AGE} <= 30")
def c14(v: Views) -> DataFrame:
    return baseline.retain(stored(v), AS_OF).select(*TASK_KEY, "template", "size")


@check("c15_baseline_clear", "SELECT dag_id, task_id, template, size FROM base_templates WHERE NOT (dag_id = 'dag_3' AND task_id = 'task_1')")
def c15(v: Views) -> DataFrame:
    return baseline.clear(learnt(v), "dag_3", "task_1").select(*TASK_KEY, "template", "size")


# ---------------------------------------------------------------- extraction and rating


_RUN_ERROR = f"""(SELECT run_id, coalesce(min_by(message, line_number) FILTER (level IN ('ERROR', 'CRITICAL', 'FATAL')),
  min_by(message, line_number) FILTER ({sql.any_of('lower(message)', fv.ERROR_KEYWORDS)}), max_by(message, line_number)) AS line
FROM run_lines GROUP BY run_id)"""


def with_error_line(v: Views) -> DataFrame:
    return logs.with_lines(v.heavy.task_runs).withColumn("line", scoring.error_line(F.col("lines")))


@check("a01_error_line", f"SELECT run_id, line FROM {_RUN_ERROR} e")
def a01(v: Views) -> DataFrame:
    return with_error_line(v).select("run_id", "line")


@check("a02_sms_line", f"""
SELECT e.run_id, CASE WHEN a <> '' AND lower(a) NOT IN ('no error', 'none', 'unknown')
  THEN CASE WHEN length(a) > 160 THEN substr(a, 1, 157) || '...' ELSE a END ELSE line END AS line
FROM {_RUN_ERROR} e JOIN (SELECT 'run_' || id AS run_id, {sql.strip('line_answer')} AS a FROM model_answers) m ON m.run_id = e.run_id""")
def a02(v: Views) -> DataFrame:
    given = v.model_answers.select(F.concat(F.lit("run_"), "id").alias("run_id"), "line_answer")
    joined = logs.with_lines(v.heavy.task_runs).join(given, "run_id")
    return joined.select("run_id", scoring.answered_line(F.col("lines"), F.col("line_answer")).alias("line"))


# Rating rules meet every error text and every document line.
_TEXTS = "(SELECT 'e' || id AS id, error_message AS t FROM error_logs UNION ALL SELECT 'd' || doc_id || '_' || line_number, message FROM doc_lines) x"


def rated_texts(v: Views) -> DataFrame:
    documents = logs.text_lines(v.texts, "doc_id", "text")
    return v.error_logs.select(F.concat(F.lit("e"), "id").alias("id"), F.col("error_message").alias("t")).unionByName(
        documents.select(F.concat(F.lit("d"), "doc_id", F.lit("_"), "line_number").alias("id"), F.col("message").alias("t")))


@check("a03_category_rules", f"SELECT id, {sql.category('t')} AS category FROM {_TEXTS}")
def a03(v: Views) -> DataFrame:
    return rated_texts(v).select("id", scoring.category(F.col("t")).alias("category"))


_V2 = {"category": 1, "severity": 2, "confidence": 3, "reasoning": 4}


def _v2(field: str) -> str:
    arms = []
    for groups, *labels in fv.CATEGORY_TERMS_V2:
        value = labels[_V2[field] - 1]
        arms.append(f"WHEN {' AND '.join(sql.any_of('lower(t)', g) for g in groups)} THEN {value if isinstance(value, float) else sql.lit(value)}")
    last = fv.CATEGORY_V2_DEFAULT[_V2[field] - 1]
    body = f"CASE {' '.join(arms)} ELSE {last if isinstance(last, float) else sql.lit(last)} END"
    return f"CAST({body} AS DOUBLE)" if field == "confidence" else body


@check("a04_category_rules_v2", f"SELECT id, {', '.join(f'{_v2(f)} AS {f}' for f in _V2)} FROM {_TEXTS}")
def a04(v: Views) -> DataFrame:
    return rated_texts(v).select("id", scoring.rate_candidate(F.col("t")).alias("r")).select("id", "r.*")


@check("a05_severity_rules", f"SELECT id, {sql.severity('t')} AS severity FROM {_TEXTS}")
def a05(v: Views) -> DataFrame:
    return rated_texts(v).select("id", scoring.severity(F.col("t")).alias("severity"))


@check("a06_confidence_rules", f"SELECT id, {sql.confidence('t')} AS confidence FROM {_TEXTS}")
def a06(v: Views) -> DataFrame:
    return rated_texts(v).select("id", scoring.confidence(F.col("t")).alias("confidence"))


@check("a07_reasoning_map", f"SELECT id, predicted_category, {sql.reasoning('predicted_category')} AS reasoning FROM ai_analysis")
def a07(v: Views) -> DataFrame:
    return v.ai_analysis.select("id", "predicted_category", scoring.reasoning(F.col("predicted_category")).alias("reasoning"))


@check("a08_structured_output", f"""
SELECT id, error_message, {sql.confidence('error_message')} AS confidence, {sql.category('error_message')} AS category,
  {sql.severity('error_message')} AS severity, {sql.reasoning(sql.category('error_message'))} AS reasoning, error_message AS error_lines
FROM error_logs""")
def a08(v: Views) -> DataFrame:
    document = F.to_json(scoring.structured_output(F.col("error_message")))
    fields = F.from_json(document, "struct<error_message:string,confidence:double,category:string,severity:string,reasoning:string,error_lines:array<string>>")
    return v.error_logs.select("id", fields.alias("o")).select("id", "o.*").withColumn("error_lines", F.array_join("error_lines", "|"))


# ---------------------------------------------------------------- answers


_BODY = "CASE WHEN ends_with(b, '```') THEN left(b, length(b) - 3) ELSE b END"
_PARSED = f"""(SELECT id, j, valid AND coalesce(try_cast(coalesce(j ->> '$.confidence', '0.5') AS DOUBLE) IS NOT NULL, false)
    AND coalesce(j ->> '$.category', 'unknown') IN ({', '.join(sql.lit(c) for c in fv.CATEGORIES)})
    AND coalesce(j ->> '$.severity', 'medium') IN ('low', 'medium', 'high', 'critical') AS good
  FROM (SELECT id, json_valid(s) AS valid, CASE WHEN json_valid(s) THEN CAST(s AS JSON) END AS j
    FROM (SELECT id, {sql.strip(_BODY)} AS s
      FROM (SELECT id, CASE WHEN starts_with(a, '```json') THEN substr(a, 8) ELSE a END AS b
        FROM (SELECT id, {sql.strip('answer')} AS a FROM model_answers) q1) q2) q3) q4) q5"""


@check("a09_parse_answer", f"""
SELECT id, CASE WHEN good THEN coalesce(j ->> '$.error_message', 'Unknown error') ELSE 'Analysis failed: Parse error' END AS error_message,
  CASE WHEN good THEN CAST(coalesce(j ->> '$.confidence', '0.5') AS DOUBLE) ELSE 0.1::DOUBLE END AS confidence,
  CASE WHEN good THEN coalesce(j ->> '$.category', 'unknown') ELSE 'unknown' END AS category,
  CASE WHEN good THEN coalesce(j ->> '$.severity', 'medium') ELSE 'medium' END AS severity,
  CASE WHEN good THEN '' ELSE 'Manual analysis required|Check logs manually' END AS suggested_actions,
  CASE WHEN good THEN coalesce(array_to_string(CAST(j -> '$.error_lines' AS VARCHAR[]), '|'), '') ELSE '' END AS raw_error_lines,
  CASE WHEN good THEN coalesce(j ->> '$.reasoning', '') ELSE 'LLM analysis failed' END AS reasoning
FROM {_PARSED}""")
def a09(v: Views) -> DataFrame:
    parsed = v.model_answers.select("id", answers.parse_answer(F.col("answer")).alias("p")).select("id", "p.*")
    return parsed.withColumns({c: F.array_join(c, "|") for c in ("suggested_actions", "raw_error_lines")})


@check("a10_fallback", """
SELECT id, 'Analysis failed: ' || err_text AS error_message, 0.1::DOUBLE AS confidence, 'unknown' AS category, 'medium' AS severity,
  'Manual analysis required|Check logs manually' AS suggested_actions, '' AS raw_error_lines, 'LLM analysis failed' AS reasoning
FROM model_answers""")
def a10(v: Views) -> DataFrame:
    made = v.model_answers.select("id", answers.fallback(F.col("err_text")).alias("p")).select("id", "p.*")
    return made.withColumns({c: F.array_join(c, "|") for c in ("suggested_actions", "raw_error_lines")})


@check("a11_parse_category", f"""
SELECT id, CASE WHEN c IN ({', '.join(sql.lit(c) for c in fv.CATEGORIES)}) THEN c ELSE 'unknown' END AS category
FROM (SELECT id, {sql.strip("regexp_replace(regexp_replace(lower(" + sql.strip('category_answer') + "), '^```.*' || chr(10), ''), chr(10) || '```$', '')")} AS c
  FROM model_answers) q""")
def a11(v: Views) -> DataFrame:
    return v.model_answers.select("id", answers.parse_category(F.col("category_answer")).alias("category"))


@check("a12_parse_steps", f"""
SELECT id, CASE WHEN len(steps) > 0 THEN array_to_string(steps, '|') ELSE 'Manual investigation required' END AS steps FROM (
SELECT id, list_filter(list_transform(list_filter(list_transform(string_split({sql.strip('steps_answer')}, chr(10)),
    lambda s: {sql.strip('s')}), lambda s: regexp_matches(s, '^[0-9*-]')),
    lambda s: regexp_replace(regexp_replace(s, '^[0-9]+\\.?{sql.WS}*', ''), '^[-*]{sql.WS}*', '')), lambda s: s <> '') AS steps
FROM model_answers) q""")
def a12(v: Views) -> DataFrame:
    return v.model_answers.select("id", F.array_join(answers.parse_steps(F.col("steps_answer")), "|").alias("steps"))


_EXAMPLES = [("log one", "answer one"), ("log two", "answer two")]
_TEMPLATE = "Examples:{few_shot_examples}Log:\n{log_context}\nDAG {dag_id} TASK {task_id} {{json}}"


@check("a13_prompts", f"""
SELECT run_id, 'Examples:' || chr(10) || {sql.lit("---".join(f"Example {n}:{chr(10)}Log Context:{chr(10)}{a}{chr(10)}{chr(10)}Expected Response:{chr(10)}{b}{chr(10)}{chr(10)}" for n, (a, b) in enumerate(_EXAMPLES, 1)).replace("---", "---" + chr(10)))}
  || '---' || chr(10) || 'Log:' || chr(10) || log_content || chr(10) || 'DAG ' || dag_id || ' TASK ' || task_id || ' {{json}}'
  || chr(10) || 'Answer with plain JSON, without Markdown.' || chr(10) AS prompt,
  'Name one category for this error.' || chr(10) || chr(10) || 'Error: ' || coalesce(err_text, '') || chr(10) || 'Context: ' || chr(10) AS category_prompt
FROM task_runs""")
def a13(v: Views) -> DataFrame:
    values = {"log_context": F.col("log_content"), "dag_id": F.col("dag_id"), "task_id": F.col("task_id")}
    asked = prompts.render("error_extraction", values, "gemini", {"error_extraction": _TEMPLATE}, _EXAMPLES)
    named = prompts.render("error_categorization", {"error_message": F.col("err_text"), "context": F.lit("")})
    return v.task_runs.select("run_id", asked.alias("prompt"), named.alias("category_prompt"))


@check("a14_no_error_result", f"""
SELECT {TRY}, 'No error patterns identified' AS error_message, 0.1::DOUBLE AS confidence, 'unknown' AS category, 'low' AS severity,
  'Review logs manually' AS actions FROM fail_stats WHERE n_candidates = 0""")
def a14(v: Views) -> DataFrame:
    return analysed(v).filter("n_candidates = 0").select(
        *TRY_KEY, "analysis.error_message", "analysis.confidence", "analysis.category", "analysis.severity",
        F.array_join("analysis.suggested_actions", "|").alias("actions"))


ANALYZE_SQL = f"""
SELECT s.dag_id, s.task_id, s.run_id, s.try_number, n_lines, n_anomalous, n_candidates,
  coalesce(n_anomalous / nullif(n_lines, 0)::DOUBLE, 0.0) AS novelty_score, n_lines > 0 AND n_candidates = 0 AS is_known_pattern,
  coalesce(error_line, 'No error patterns identified') AS error_message,
  CASE WHEN error_line IS NULL THEN 0.1::DOUBLE ELSE {sql.confidence('error_line')} END AS confidence,
  CASE WHEN error_line IS NULL THEN 'unknown' ELSE {sql.category('error_line')} END AS category,
  CASE WHEN error_line IS NULL THEN 'low' ELSE {sql.severity('error_line')} END AS severity,
  CASE WHEN error_line IS NULL THEN '' ELSE {sql.reasoning(sql.category('error_line'))} END AS reasoning,
  CASE WHEN error_line IS NULL THEN 'Review logs manually' ELSE '' END AS actions
FROM fail_stats s LEFT JOIN fail_errors e ON e.dag_id = s.dag_id AND e.task_id = s.task_id AND e.run_id = s.run_id AND e.try_number = s.try_number"""


@check("a15_analyze_tries", ANALYZE_SQL)
def a15(v: Views) -> DataFrame:
    return entry_query(v)


@check("a15_analyze_tries_tree")
def a15_tree(v: Views) -> DataFrame:
    result = plan.analyze_tries(v.task_runs, v.task_tries, v.heavy.task_tries, AS_OF, minutes_back=WHOLE_PERIOD, exact=True)
    return result.select(*TRY_KEY, "n_lines", "n_anomalous", "n_candidates", "novelty_score", "analysis.error_message", "analysis.category")


_STEPS = f"""list_filter(list_transform(list_filter(list_transform(string_split({sql.strip('steps_answer')}, chr(10)),
    lambda s: {sql.strip('s')}), lambda s: regexp_matches(s, '^[0-9*-]')),
    lambda s: regexp_replace(regexp_replace(s, '^[0-9]+\\.?{sql.WS}*', ''), '^[-*]{sql.WS}*', '')), lambda s: s <> '')"""


@check("a15_result_rows", f"""
SELECT sha256(dag_id || chr(31) || task_id || chr(31) || run_id || chr(31) || try_number) AS id, {TRY}, failure IS NULL AS success, failure AS error_message,
  CASE WHEN failure IS NULL THEN found END AS found, CASE WHEN failure IS NULL THEN n_candidates END AS n_related,
  CASE WHEN failure IS NULL THEN CASE WHEN n_candidates = 0 THEN 'Review logs manually'
    WHEN steps IS NULL THEN 'Manual investigation required|Check system logs|Contact support'
    WHEN len(steps) = 0 THEN 'Manual investigation required' ELSE array_to_string(steps, '|') END END AS actions
FROM (SELECT s.dag_id, s.task_id, s.run_id, s.try_number, n_candidates, coalesce(error_line, 'No error patterns identified') AS found,
    CASE WHEN m.id % 3 <> 0 THEN {_STEPS} END AS steps, CASE WHEN m.id % 13 = 0 THEN 'provider timed out' END AS failure
  FROM fail_stats s JOIN model_answers m ON s.run_id = 'run_' || m.id
  LEFT JOIN fail_errors e ON e.dag_id = s.dag_id AND e.task_id = s.task_id AND e.run_id = s.run_id AND e.try_number = s.try_number) q""")
def a15_rows(v: Views) -> DataFrame:
    answered = v.model_answers.select(
        F.concat(F.lit("run_"), F.col("id").cast("string")).alias("run_id"), F.when(F.col("id") % 3 != 0, F.col("steps_answer")).alias("steps"),
        F.when(F.col("id") % 13 == 0, "provider timed out").alias("failure"))
    rows = plan.result_rows(plan.with_steps(analysed(v).join(answered, "run_id"), "steps"), AS_OF, "failure")
    return rows.select("id", *TRY_KEY, "success", "error_message", F.col("analysis.error_message").alias("found"),
                       F.when(F.col("success"), F.size("analysis.related_logs")).alias("n_related"),
                       F.array_join("analysis.suggested_actions", "|").alias("actions"))


@check("a16_error_candidates", f"""
SELECT {TRY}, line_number, message FROM fail_ruled WHERE anomalous AND matched_rule IS NULL
UNION ALL SELECT {TRY}, NULL, CASE WHEN n_lines = 0 THEN 'No failed logs found' ELSE dag_id || '.' || task_id || ': No error patterns identified' END
FROM fail_stats WHERE n_candidates = 0""")
def a16(v: Views) -> DataFrame:
    return plan.candidate_lines(analysed(v))


SUMMARY_SQL = f"""
SELECT s.dag_id, s.task_id, s.run_id, s.try_number, CASE WHEN error_line IS NULL THEN s.dag_id || '.' || s.task_id || ': No error patterns identified'
  ELSE 'DAG: ' || s.dag_id || ' Task: ' || s.task_id || ': ' || CASE WHEN length(error_line) > 160 THEN substr(error_line, 1, 157) || '...' ELSE error_line END END
  || ' Attempt: ' || s.try_number AS summary
FROM fail_stats s LEFT JOIN fail_errors e ON e.dag_id = s.dag_id AND e.task_id = s.task_id AND e.run_id = s.run_id AND e.try_number = s.try_number"""


@check("p11_run_summary", SUMMARY_SQL)
def p11(v: Views) -> DataFrame:
    return plan.summaries(analysed(v))


@check("p13_candidate_text", f"SELECT {TRY}, candidate_text FROM fail_errors")
def p13(v: Views) -> DataFrame:
    return compared(v).filter("n_candidates > 0").select(
        *TRY_KEY, scoring.joined_messages(F.col("candidates")).alias("candidate_text"))


# ---------------------------------------------------------------- user code


@check("u01_register_predicate", f"SELECT {TRY}, line_number FROM run_lines WHERE contains(message, 'rows') AND length(message) % 2 = 0")
def u01(v: Views) -> DataFrame:
    even = extension.vectorised_predicate(lambda messages: messages.str.contains("rows") & (messages.str.len() % 2 == 0))
    chosen = rules.RuleSet().register("even_rows", even)
    entries = logs.log_entries(v.heavy.task_runs)
    return entries.filter(rules.any_rule(chosen, rules.line_view(F.col("message")))).select(*TRY_KEY, "line_number")


@check("u03_answer_provider", "SELECT id, upper(err_text) AS answer FROM model_answers")
def u03(v: Views) -> DataFrame:
    asked = v.model_answers.select("id", F.col("err_text").alias("prompt"))
    return extension.with_answers(asked, lambda texts: [t.upper() for t in texts]).select("id", "answer")



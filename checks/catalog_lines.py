"""Checked queries over tasks, raw logs, single lines and filter rules."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql
from checks.registry import check
from checks.views import AS_OF, AS_OF_SQL, Duck, Spark, Views
from tasklore.functions import fixed_values as fv
from tasklore.functions import parsing, rules, scoring, templates, text
from tasklore.operators import logs, tasks
from tasklore.schemas import TRY_KEY

LINE = "dag_id, task_id, run_id, try_number, line_number"
LINE_KEY = [*TRY_KEY, "line_number"]


def run_entries(v: Views) -> DataFrame:
    return logs.log_entries(v.heavy.task_runs)


# ---------------------------------------------------------------- scans


@check("s01_failed_tasks", f"""
SELECT dag_id, task_id, run_id, 'failed' AS state, start_date, end_date, -1 AS try_number FROM task_runs
WHERE state = 'failed' AND start_date >= {AS_OF_SQL} - INTERVAL 21600 MINUTE""")
def s01(v: Views) -> DataFrame:
    return tasks.failed_tasks(v.task_runs, AS_OF, minutes_back=15 * 24 * 60)


@check("s02_recent_successes", "SELECT dag_id, task_id, run_id, try_number, state, start_date, end_date, recency FROM base_runs")
def s02(v: Views) -> DataFrame:
    return tasks.recent_successes(v.task_runs)


@check("s03_task_tries", """
SELECT dag_id, task_id, run_id, try_number, state,
  CASE WHEN try_number > 0 THEN date_trunc('second', start_date) END AS start_date,
  date_trunc('second', end_date) AS end_date
FROM task_tries WHERE run_id IN (SELECT run_id FROM task_fail)""")
def s03(v: Views) -> DataFrame:
    iso = v.task_tries.withColumns({
        "start_date": F.when(F.col("try_number") > 0, F.concat(F.expr(Spark.iso("start_date")), F.lit("Z"))).otherwise("n/a"),
        "end_date": F.concat(F.expr(Spark.iso("end_date")), F.lit("Z"))})
    return tasks.task_tries(v.task_fail, iso)


@check("s04_failed_tries", "SELECT dag_id, task_id, run_id, try_number, state, start_date, end_date FROM fail_tries")
def s04(v: Views) -> DataFrame:
    return tasks.failed_tries(v.task_fail, v.task_tries).select(*TRY_KEY, "state", "start_date", "end_date")


@check("j06_run_logs", "SELECT dag_id, task_id, run_id, try_number, start_date, end_date, log_content FROM fail_tries")
def j06(v: Views) -> DataFrame:
    return tasks.run_logs(v.task_fail, v.task_tries, v.heavy.task_tries)


# ---------------------------------------------------------------- parsing


@check("p01_log_lines", f"""
SELECT {LINE}, orig_line_number, raw_content FROM run_lines
UNION ALL SELECT 'documents', '-', CAST(doc_id AS VARCHAR), 0, line_number, line_number, message FROM doc_lines""")
def p01(v: Views) -> DataFrame:
    key = [F.lit("documents").alias("dag_id"), F.lit("-").alias("task_id"), F.col("doc_id").cast("string").alias("run_id")]
    documents = logs.text_lines(v.texts, "doc_id", "text").select(
        *key, F.lit(0).alias("try_number"), "line_number", F.col("line_number").alias("orig_line_number"),
        F.col("message").alias("raw_content"))
    return run_entries(v).select(*LINE_KEY, "orig_line_number", "raw_content").unionByName(documents)


@check("p01_log_tail", f"SELECT {LINE}, orig_line_number, message FROM ({sql.lines('task_runs', 5)}) cut")
def p01_tail(v: Views) -> DataFrame:
    return logs.log_entries(v.heavy.task_runs, max_lines=5).select(*LINE_KEY, "orig_line_number", "message")


@check("p02_event_time", f"SELECT {LINE}, ts FROM run_lines")
def p02(v: Views) -> DataFrame:
    return run_entries(v).select(*LINE_KEY, "ts")


@check("p03_level", f"SELECT {LINE}, level FROM run_lines")
def p03(v: Views) -> DataFrame:
    return run_entries(v).select(*LINE_KEY, "level")


@check("p04_message", f"SELECT {LINE}, message, raw_content FROM run_lines")
def p04(v: Views) -> DataFrame:
    return run_entries(v).select(*LINE_KEY, "message", "raw_content")


@check("p05_tz_shift", """
SELECT run_id, start_date + INTERVAL 390 MINUTE AS start_date, end_date + INTERVAL 390 MINUTE AS end_date,
  start_date - INTERVAL 210 MINUTE AS west, start_date AS malformed, start_date AS zero FROM task_runs""")
def p05(v: Views) -> DataFrame:
    shifted = tasks.shift_times(v.task_runs.withColumn("start", F.col("start_date")), "+06:30")
    return shifted.select("run_id", "start_date", "end_date", parsing.shift_time(F.col("start"), "-03:30").alias("west"),
                          parsing.shift_time(F.col("start"), "+6h").alias("malformed"),
                          parsing.shift_time(F.col("start"), "+00:00").alias("zero"))


@check("p06_preview", """
SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS preview FROM documents""")
def p06(v: Views) -> DataFrame:
    return v.texts.select("doc_id", text.preview(F.col("text")).alias("preview"))


@check("p07_sms_truncate", """
SELECT run_id, CASE WHEN length(log_content) > 160 THEN substr(log_content, 1, 157) || '...' ELSE log_content END AS short
FROM task_runs""")
def p07(v: Views) -> DataFrame:
    return v.task_runs.select("run_id", text.short_text(F.col("log_content")).alias("short"))


def _context(n: int) -> str:
    return f"""(SELECT run_id, string_agg('[' || {Duck.fmt('ts')} || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || '] ' || level || ': ' || message, chr(10) ORDER BY line_number) AS c
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY line_number DESC) AS back FROM run_lines) t WHERE back <= {n} GROUP BY run_id)"""


@check("p08_log_context", f"SELECT a.run_id, a.c AS last_ten, b.c AS last_three FROM {_context(10)} a JOIN {_context(3)} b ON a.run_id = b.run_id")
def p08(v: Views) -> DataFrame:
    lines = logs.with_lines(v.heavy.task_runs)
    return lines.select("run_id", scoring.context(F.col("lines")).alias("last_ten"),
                        scoring.context(F.col("lines"), 3).alias("last_three"))


_ID_TEXT = """CASE k % 4 WHEN 0 THEN concat('AIRFLOW_CTX_DAG_ID=', dag_id, chr(10), 'TASK_ID: ', chr(39), task_id, chr(39), ', DAG_RUN_ID="', run_id, '"')
  WHEN 1 THEN concat('DAG_ID:', dag_id) WHEN 2 THEN concat('TASK_ID = ', task_id) ELSE log_content END"""


@check("p09_extract_ids", f"""
SELECT run_id, coalesce(nullif(regexp_extract(t, 'DAG_ID[=:]\\s*[''"]?([^''",$\\s]+)', 1), ''), 'unknown') AS dag,
  coalesce(nullif(regexp_extract(t, 'TASK_ID[=:]\\s*[''"]?([^''",$\\s]+)', 1), ''), 'unknown') AS task,
  coalesce(nullif(regexp_extract(t, 'DAG_RUN_ID[=:]\\s*[''"]?([^''",$\\s]+)', 1), ''), 'unknown') AS run
FROM (SELECT run_id, {_ID_TEXT} AS t FROM task_runs) x""")
def p09(v: Views) -> DataFrame:
    log = F.expr(_ID_TEXT)
    return v.task_runs.withColumn("t", log).select("run_id", *[
        parsing.extract_id(F.col("t"), name).alias(out)
        for name, out in (("DAG_ID", "dag"), ("TASK_ID", "task"), ("DAG_RUN_ID", "run"))])


@check("p10_dag_glob", "SELECT dag_id, run_id FROM task_runs WHERE lower(dag_id) SIMILAR TO 'dag_[1-4].*' OR lower(dag_id) = 'dag_7'")
def p10(v: Views) -> DataFrame:
    runs = v.task_runs.select("dag_id", "run_id")
    return tasks.by_dag_pattern(runs, "DAG_[1-4]*").unionByName(tasks.by_dag_pattern(runs, "d?g_7"))


@check("p14_redact", """
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
  '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', '<EMAIL>', 'g'),
  '(password|passwd|pwd|secret|token|api[_-]?key)(\\s*[=:]\\s*)[^\\s,;]+', '\\1\\2<SECRET>', 'gi'),
  '(^|[^0-9.])[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}($|[^0-9.])', '\\1<ADDRESS>\\2', 'g'),
  '(^|[^0-9.])[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}($|[^0-9.])', '\\1<ADDRESS>\\2', 'g'),
  '[0-9a-fA-F]{32,}', '<HEX>', 'g'), '[0-9]{9,}', '<DIGITS>', 'g') AS redacted FROM documents""")
def p14(v: Views) -> DataFrame:
    return v.texts.select("doc_id", text.redact(F.col("text")).alias("redacted"))


# ---------------------------------------------------------------- rules


def rule_query(name: str, rule: rules.Rule, oracle: str) -> None:
    @check(name, f"SELECT {LINE} FROM run_lines WHERE {oracle}")
    def query(v: Views) -> DataFrame:
        return run_entries(v).filter(rules.rule_test(rule, rules.line_view(F.col("message")))).select(*LINE_KEY)


rule_query("f01_regex", rules.Rule("regex", r"time(out|d out).*\d+ SECONDS"), "regexp_matches(message, 'time(out|d out).*[0-9]+ SECONDS', 'i')")


@check("f01_regex_invalid", f"SELECT {LINE} FROM run_lines")
def f01_invalid(v: Views) -> DataFrame:
    """An unusable pattern matches nothing, even negated, so every line is kept."""
    broken = rules.rule_test(rules.Rule("regex", "([unclosed", negate=True), rules.line_view(F.col("message")))
    return run_entries(v).filter(~broken).select(*LINE_KEY)


rule_query("f01_regex_negated", rules.Rule("regex", "ERROR|Traceback", case_sensitive=True, negate=True), "NOT regexp_matches(message, 'ERROR|Traceback')")
rule_query("f02_substring", rules.Rule("substring", "MARKING task"), "contains(lower(message), 'marking task')")
rule_query("f02_substring_case", rules.Rule("substring", "Host", case_sensitive=True, negate=True), "NOT contains(message, 'Host')")
rule_query("f03_starts_with", rules.Rule("starts_with", "traceback"), "starts_with(lower(message), 'traceback')")
rule_query("f04_ends_with", rules.Rule("ends_with", "CODE 0"), "ends_with(lower(message), 'code 0')")
rule_query("f05_length_below", rules.Rule("length_threshold", "45"), f"length({sql.strip('message')}) < 45")


@check("f06_custom_predicate", f"SELECT {LINE} FROM run_lines WHERE level = 'ERROR' AND length(message) < 60")
def f06(v: Views) -> DataFrame:
    chosen = rules.RuleSet().register("short_error", lambda line: (line["level"] == "ERROR") & (F.length(line["message"]) < 60))
    chosen = chosen.add(rules.Rule("custom_function", "never_registered", negate=True))
    entries = run_entries(v)
    return entries.filter(rules.any_rule(chosen, rules.line_view(F.col("message"), level=F.col("level")))).select(*LINE_KEY)


@check("f07_rule_filter", f"""
SELECT {LINE}, message FROM run_lines WHERE {sql.first_rule([(sql.rule(k, p), d) for k, p, d in fv.SHIPPED_RULES])} IS NULL""")
def f07(v: Views) -> DataFrame:
    return run_entries(v).filter(~rules.any_rule(rules.shipped_rules(), rules.line_view(F.col("message")))).select(*LINE_KEY, "message")


@check("f07_default_rules", f"""
SELECT {LINE}, message FROM run_lines WHERE {sql.first_rule([(sql.rule(k, p), d) for k, p, d in fv.DEFAULT_RULES])} IS NULL""")
def f07_default(v: Views) -> DataFrame:
    return run_entries(v).filter(~rules.any_rule(rules.default_rules(), rules.line_view(F.col("message")))).select(*LINE_KEY, "message")


@check("f08_rule_attribution", f"""
SELECT matched_rule, count(*) AS removed FROM (SELECT {sql.first_rule(sql.NOTIFICATION)} AS matched_rule FROM run_lines) r
WHERE matched_rule IS NOT NULL GROUP BY 1""")
def f08(v: Views) -> DataFrame:
    label = rules.first_rule(rules.preset("notification"), rules.line_view(F.col("message")))
    counted = run_entries(v).withColumn("rule", label).groupBy("rule").agg(F.count("rule").alias("removed"))
    return counted.filter("removed > 0").withColumnRenamed("rule", "matched_rule")


def _score_sql(levels: list[str], words: list[str]) -> str:
    hits = " + ".join(f"CAST(contains(lower(message), {sql.lit(w)}) AS INTEGER)" for w in words)
    names = ", ".join(sql.lit(level) for level in levels)
    return (f"CASE WHEN level IN ({names}) THEN 0.8::DOUBLE ELSE 0::DOUBLE END + least(0.6::DOUBLE, ({hits}) * 0.2::DOUBLE)"
            f" + CASE WHEN {sql.any_of('message', fv.TRACE_MARKS)} THEN 0.3::DOUBLE ELSE 0::DOUBLE END")


@check("f10_error_score", f"""
SELECT {LINE}, s1 AS score, s1 >= 0.3 AS is_candidate, s2 AS shipped_score, s2 >= 0.2 AS shipped_candidate FROM (
SELECT {LINE}, {_score_sql(fv.ERROR_LEVELS, fv.DEFAULT_INDICATORS)} AS s1,
  {_score_sql(fv.SHIPPED_SCORE_LEVELS, fv.SHIPPED_INDICATORS)} AS s2 FROM run_lines) scored""")
def f10(v: Views) -> DataFrame:
    plain, shipped = rules.ScoreSettings(), rules.SHIPPED_SCORE
    scored = run_entries(v).select(
        *LINE_KEY, rules.error_score(F.col("message"), F.col("level"), plain).alias("score"),
        rules.error_score(F.col("message"), F.col("level"), shipped).alias("shipped_score"))
    return scored.withColumns({"is_candidate": rules.is_error_candidate(F.col("score"), plain),
                               "shipped_candidate": rules.is_error_candidate(F.col("shipped_score"), shipped)})


# Lines of runs and documents followed by a phrase, so that each phrase group meets every kind of line.
_PHRASES = [*fv.NOTIFICATION_SPAM, "timezone offset +00:00 in use", "Using ollama provider", "Configuration loaded successfully",
            "SSL verification enabled", "Converting timezone", "Connecting to http://scheduler", "Using timeout 30",
            "Using ollama as default provider", "Temperature set to 0.1", "Drain3 depth: 4", "Similarity threshold: 0.4",
            "Template matched", "nothing special"]
_PHRASE_SQL = "CASE line_number % {n} ".format(n=len(_PHRASES)) + " ".join(
    f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + " END"
_NOISY = f"(SELECT {LINE}, concat(message, ' ', {_PHRASE_SQL}) AS message FROM (SELECT dag_id, task_id, run_id, try_number, line_number, message FROM run_lines UNION ALL SELECT 'documents', '-', CAST(doc_id AS VARCHAR), 0, line_number, message FROM doc_lines) u)"


def noisy(v: Views) -> DataFrame:
    documents = logs.text_lines(v.texts, "doc_id", "text").select(
        F.lit("documents").alias("dag_id"), F.lit("-").alias("task_id"), F.col("doc_id").cast("string").alias("run_id"),
        F.lit(0).alias("try_number"), "line_number", "message")
    both = run_entries(v).select(*LINE_KEY, "message").unionByName(documents)
    return both.withColumn("message", F.concat("message", F.lit(" "), F.expr(_PHRASE_SQL)))


@check("f11_noise_spam", f"SELECT {LINE} FROM {_NOISY} n WHERE NOT {sql.SPAM}")
def f11(v: Views) -> DataFrame:
    return noisy(v).filter(~rules.notification_spam(F.col("message"))).select(*LINE_KEY)


_SETTINGS = rules.NoiseSettings(base_url="http://scheduler")


@check("f12_noise_config", f"""
SELECT {LINE}, {sql.CONFIG_NOISE} AS config_noise,
  {sql.any_of('message', ['timezone offset +00:00', 'Converting timezone', 'UTC offset applied'])} AS timezone,
  {sql.any_of('message', ['Connecting to http://scheduler', 'Using timeout 30', 'SSL verification enabled', 'Configuration loaded successfully'])} AS scheduler_config,
  {sql.any_of('message', ['Using ollama as default provider', 'Model loaded successfully', 'LLM engine initialized', 'Temperature set to'])} AS model,
  {sql.any_of('message', ['Drain3 depth: 4', 'Similarity threshold: 0.4', 'Cluster created', 'Template matched', 'Persistence saved'])} AS clustering
FROM {_NOISY} n""")
def f12(v: Views) -> DataFrame:
    groups = rules.integration_noise(F.col("message"), _SETTINGS)
    return noisy(v).select(*LINE_KEY, rules.config_noise(F.col("message"), _SETTINGS).alias("config_noise"),
                           *[test.alias(name) for name, test in groups.items()])


@check("f13_standard_line", f"SELECT {LINE} FROM run_lines WHERE NOT {sql.NOT_STANDARD}")
def f13(v: Views) -> DataFrame:
    return run_entries(v).filter(~rules.not_standard_line(F.col("message"))).select(*LINE_KEY)


_SMS_OFF = [*sql.NOTIFICATION, (sql.rule("regex", "SMS.*disabled"), "SMS disabled messages")]


@check("f14_presets", f"""
SELECT {LINE}, {sql.first_rule(_SMS_OFF)} AS notification,
  {sql.first_rule([(sql.rule(k, p), d) for k, p, d in fv.SHIPPED_RULES])} AS analysis FROM run_lines""")
def f14(v: Views) -> DataFrame:
    line = rules.line_view(F.col("message"))
    notification = rules.preset("notification", rules.NoiseSettings(sms_enabled=False))
    return run_entries(v).select(*LINE_KEY, rules.first_rule(notification, line).alias("notification"),
                                 rules.first_rule(rules.preset("analysis"), line).alias("analysis"))


# ---------------------------------------------------------------- masks and templates


def all_messages(v: Views) -> DataFrame:
    documents = logs.text_lines(v.texts, "doc_id", "text")
    return run_entries(v).select("run_id", "line_number", "message").unionByName(
        documents.select(F.concat(F.lit("doc_"), F.col("doc_id")).alias("run_id"), "line_number", "message"))


_ALL = "(SELECT run_id, line_number, message FROM run_lines UNION ALL SELECT 'doc_' || doc_id, line_number, message FROM doc_lines) m"


@check("c01_mask", f"SELECT run_id, line_number, {sql.mask('message')} AS masked FROM {_ALL}")
def c01(v: Views) -> DataFrame:
    return all_messages(v).select("run_id", "line_number", templates.mask(F.col("message")).alias("masked"))


@check("c02_tokenize", f"""
SELECT run_id, line_number, CASE WHEN n = '' THEN 0 ELSE len(string_split(n, ' ')) END AS n_tokens,
  replace(n, ' ', '|') AS tokens FROM (SELECT run_id, line_number, {sql.normal('message')} AS n FROM {_ALL}) t""")
def c02(v: Views) -> DataFrame:
    cut = all_messages(v).select("run_id", "line_number", templates.tokenize(F.col("message")).alias("t"))
    return cut.select("run_id", "line_number", F.size("t").alias("n_tokens"), F.array_join("t", "|").alias("tokens"))


@check("c04_shape_template", f"""
SELECT template, count(*) AS lines FROM (SELECT {sql.shape('message')} AS template FROM {_ALL}) t GROUP BY 1""")
def c04(v: Views) -> DataFrame:
    return all_messages(v).groupBy(templates.shape_template(F.col("message")).alias("template")).agg(F.count("*").alias("lines"))



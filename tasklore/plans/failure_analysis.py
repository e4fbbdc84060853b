"""From failed tries to analysed results, for all tries at once.

The result is lazy, but planning it writes and measures the small key tables (failed tries, baseline runs, template arrays).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklore.functions import answers, fixed_values as fv, rules, scoring, text
from tasklore.operators import baseline as baselines
from tasklore.operators import logs as log_ops
from tasklore.operators import novelty as novelties
from tasklore.operators import tasks as task_ops
from tasklore.schemas import TASK_KEY, TRY_KEY


def surviving(lines: Column, rule_set: rules.RuleSet) -> Column:
    """Lines of an array that no rule drops. Lower-casing is done once per line, not once per rule."""
    prepared = F.transform(lines, lambda item: item.withField("lowered", F.lower(item["message"])))
    kept = F.filter(prepared, lambda item: ~rules.any_rule(rule_set, {
        name: item[name] for name in ("message", "lowered", "level", "line_number", "raw_content")}))
    return F.transform(kept, lambda item: item.dropFields("lowered"))


def candidates_per_try(tries: DataFrame, baseline: DataFrame, rule_set: rules.RuleSet,
                       max_lines: int | None = None, exact: bool = False) -> DataFrame:
    """Add ``lines``, ``anomalous`` and ``candidates``; ``exact`` uses the template tree instead of shapes."""
    find = novelties.tree_novelty if exact else novelties.shape_novelty
    return log_ops.pin(find(tries, baseline, max_lines), candidates=surviving(F.col("anomalous"), rule_set))


def compare(analysed: DataFrame) -> DataFrame:
    """Novelty before the rules, known when no candidate is left; an empty log scores 0 and is not known."""
    return analysed.select(
        *TRY_KEY, "start_date", "lines", "anomalous", "candidates",
        F.size("lines").alias("n_lines"), F.size("anomalous").alias("n_anomalous"),
        F.size("candidates").alias("n_candidates"),
        novelties.novelty_score(F.col("lines"), F.col("anomalous")).alias("novelty_score"),
        ((F.size("lines") > 0) & (F.size("candidates") == 0)).alias("is_known_pattern"),
        F.size(F.coalesce("known", F.array().cast("array<string>"))).alias("baseline_size"), "baseline_updated",
    )


def analyse(compared: DataFrame, answer: str | None = None) -> DataFrame:
    """Attach the analysis struct: the rules' answer, or a parsed model answer when a column is named."""
    error = scoring.error_line(F.col("candidates"))
    located = log_ops.pin(compared, error_line=error)
    by_rules = scoring.structured_output(F.col("error_line"))
    found = F.struct(
        by_rules["error_message"].alias("error_message"), by_rules["confidence"].alias("confidence"),
        by_rules["category"].alias("category"), by_rules["severity"].alias("severity"),
        F.array().cast("array<string>").alias("suggested_actions"),
        by_rules["error_lines"].alias("raw_error_lines"), by_rules["reasoning"].alias("reasoning"),
    )
    if answer is not None:
        found = answers.parse_answer(F.col(answer))
    chosen = F.when(F.col("n_candidates") == 0, answers.no_error_result()).otherwise(found)
    return located.withColumn("analysis", chosen)


def analyze_tries(tasks: DataFrame, tries: DataFrame, logs: DataFrame, as_of: datetime,
                  minutes_back: int = fv.LOOKBACK_MINUTES, rule_set: rules.RuleSet | None = None,
                  baseline: DataFrame | None = None, exact: bool = False,
                  runs: int = fv.BASELINE_RUNS, max_lines: int | None = None) -> DataFrame:
    """One result row per failed try of the tasks that failed in the look-back window.

    A stored baseline can be passed in; otherwise it is learnt from the latest successful runs of the
    failed tasks in the same plan: logs of tasks that did not fail are dropped by key at the scan.
    """
    rule_set = rules.preset("notification") if rule_set is None else rule_set
    failed = task_ops.failed_tasks(tasks, as_of, minutes_back)
    texts = task_ops.run_logs(failed, tries, logs)
    if baseline is None:
        needed = tasks.join(failed.select(*TASK_KEY).distinct(), TASK_KEY, "left_semi")
        learnt = baselines.baseline_lines(needed, logs, runs, max_lines)
        build = baselines.tree_baseline if exact else baselines.shape_baseline
        baseline = build(learnt, as_of)
    return analyse(compare(candidates_per_try(texts, baseline, rule_set, max_lines, exact)))


def with_steps(analysed: DataFrame, steps: str | None = None) -> DataFrame:
    """Suggested actions of tries with candidates: the steps of an answer column, or the fixed ones where there is no answer."""
    nothing = F.array(*[F.lit(step) for step in fv.NO_ANSWER_STEPS])
    found = nothing if steps is None else F.when(F.col(steps).isNull(), nothing).otherwise(answers.parse_steps(F.col(steps)))
    chosen = F.when(F.col("n_candidates") > 0, found).otherwise(F.col("analysis.suggested_actions"))
    return analysed.withColumn("analysis", F.col("analysis").withField("suggested_actions", chosen))


def result_rows(analysed: DataFrame, as_of: datetime, failure: str | None = None) -> DataFrame:
    """Flat ``analysis_results`` with the two nested parts kept as structs; the analysis carries its candidate lines as ``related_logs``.

    ``failure`` names a column that tells why a try could not be analysed; such a row has neither part, only the reason.
    """
    reason = F.lit(None).cast("string") if failure is None else F.col(failure)
    analysis = F.col("analysis").withField("related_logs", F.col("candidates"))
    comparison = F.struct(
        "is_known_pattern", F.array().cast("array<string>").alias("similar_clusters"), "novelty_score",
        F.coalesce(baselines.age_days(as_of, F.col("baseline_updated")), F.lit(0)).alias("baseline_age_days"))
    return analysed.select(
        F.sha2(F.concat_ws("\x1f", *TRY_KEY), 256).alias("id"), *TRY_KEY,
        F.when(reason.isNull(), analysis).alias("analysis"), F.when(reason.isNull(), comparison).alias("baseline_comparison"),
        F.lit(as_of).cast("timestamp_ntz").alias("timestamp"), reason.isNull().alias("success"), reason.alias("error_message"))


def candidate_lines(analysed: DataFrame) -> DataFrame:
    """Surviving lines per try, or one message row when there are none."""
    message = (F.when(F.col("n_lines") == 0, F.lit(fv.NO_LOGS))
               .otherwise(F.concat("dag_id", F.lit("."), "task_id", F.lit(": " + fv.NO_PATTERNS))))
    placeholder = F.array(F.struct(F.lit(None).cast("int").alias("line_number"), message.alias("message")))
    found = F.transform("candidates", lambda item: F.struct(
        item["line_number"].alias("line_number"), item["message"].alias("message")))
    return analysed.select(*TRY_KEY, F.inline(F.when(F.col("n_candidates") == 0, placeholder).otherwise(found)))


def run_summary(dag_id: Column, task_id: Column, line: Column | None, try_number: Column) -> Column:
    """Short text of a failed try; a null line means nothing was identified."""
    nothing = F.concat(dag_id, F.lit("."), task_id, F.lit(": " + fv.NO_PATTERNS))
    found = F.concat(F.lit("DAG: "), dag_id, F.lit(" Task: "), task_id, F.lit(": "), line)
    return F.concat(F.coalesce(found, nothing), F.lit(" Attempt: "), try_number.cast("string"))


def summaries(analysed: DataFrame) -> DataFrame:
    line = F.when(F.col("n_candidates") > 0, text.short_text(F.col("error_line")))
    return analysed.select(*TRY_KEY, run_summary(F.col("dag_id"), F.col("task_id"), line, F.col("try_number")).alias("summary"))

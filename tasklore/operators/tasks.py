"""Task runs and tries: which ones failed, which ones can serve as a baseline."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import parsing, text
from tasklore.operators.sizing import join_measured
from tasklore.schemas import RUN_KEY, TASK_KEY, TRY_KEY


def failed_tasks(tasks: DataFrame, as_of: datetime, minutes_back: int = fv.LOOKBACK_MINUTES) -> DataFrame:
    """Failed tasks that started in the look-back window, newest first.

    The filter compares the stored column with a literal, so it reaches the scan.
    """
    since = F.lit(as_of - timedelta(minutes=minutes_back))
    return (
        tasks.filter((F.col("state") == "failed") & (F.col("start_date") >= since))
        .select(*RUN_KEY, F.lit("failed").alias("state"), "start_date", "end_date", F.lit(-1).alias("try_number"))
        .orderBy(F.col("start_date").desc(), *RUN_KEY)
    )


def recent_successes(tasks: DataFrame, runs: int = fv.BASELINE_RUNS) -> DataFrame:
    """The last successful first-try runs of every (dag, task).

    Spark cuts each input partition to ``runs`` rows per key before the shuffle (window group limit), so
    a key holding most of the table still moves only a few rows. Only key columns pass through the window.
    """
    newest = Window.partitionBy(*TASK_KEY).orderBy(F.col("end_date").desc(), "run_id")
    return (
        tasks.filter((F.col("state") == "success") & (F.col("try_number") == 1))
        .select(*RUN_KEY, "try_number", "state", "start_date", "end_date")
        .withColumn("recency", F.row_number().over(newest))
        .filter(F.col("recency") <= runs)
    )


def task_tries(runs: DataFrame, tries: DataFrame) -> DataFrame:
    """All tries of the given runs; text times are ISO-8601 with Z, unreadable ones become null."""
    def read_time(name: str):
        column = F.col(name)
        if dict(tries.dtypes)[name] != "string":
            return column
        return F.regexp_replace(column, "Z$", "").try_cast("timestamp_ntz").alias(name)

    times = [read_time("start_date"), read_time("end_date")]
    return tries.select(*TRY_KEY, "state", *times).join(runs.select(*RUN_KEY).distinct(), RUN_KEY, "left_semi")


def failed_tries(tasks: DataFrame, tries: DataFrame) -> DataFrame:
    """Failed tries (numbers above zero) of the given failed tasks."""
    failed = tries.filter((F.col("state") == "failed") & (F.col("try_number") > 0))
    return failed.join(tasks.select(*RUN_KEY).distinct(), RUN_KEY, "left_semi")


def run_logs(tasks: DataFrame, tries: DataFrame, logs: DataFrame) -> DataFrame:
    """Failed tasks to failed tries to their logs.

    ``logs`` holds one text per try. The keys are found and measured first; while they are small enough
    to broadcast, no text is shuffled.
    """
    keys = failed_tries(tasks, tries).select(*TRY_KEY, "start_date", "end_date")
    return join_measured(logs.select(*TRY_KEY, "log_content"), keys, TRY_KEY, "failed-tries")


def shift_times(tasks: DataFrame, offset: str, columns: tuple[str, ...] = ("start_date", "end_date")) -> DataFrame:
    return tasks.withColumns({name: parsing.shift_time(F.col(name), offset) for name in columns})


def by_dag_pattern(tasks: DataFrame, pattern: str) -> DataFrame:
    """Tasks whose dag id matches a shell glob, whatever the case."""
    return tasks.filter(text.matches_glob(F.col("dag_id"), pattern))

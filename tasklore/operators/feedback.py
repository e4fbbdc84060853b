"""Joins and statistics over error logs, analyses and human feedback."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import text

ANALYSIS_COLUMNS = ["extracted_error", "predicted_category", "predicted_severity", "confidence_score"]
FEEDBACK_COLUMNS = ["corrected_error", "corrected_category", "corrected_severity", "user_rating"]


def daily_errors(errors: DataFrame, analyses: DataFrame, feedback: DataFrame, day: date) -> DataFrame:
    """Errors of one day with every analysis and feedback row, newest first."""
    a = analyses.select(F.col("error_log_id").alias("id"), *ANALYSIS_COLUMNS)
    f = feedback.select(F.col("error_log_id").alias("id"), *FEEDBACK_COLUMNS)
    return (
        errors.filter(F.col("dt") == F.lit(day))
        .join(a, "id", "left").join(f, "id", "left")
        .withColumns({
            "has_analysis": F.coalesce(F.col("extracted_error") != "", F.lit(False)),
            "has_feedback": F.coalesce(F.col("corrected_error") != "", F.lit(False)),
        })
        .orderBy(F.col("ts").desc(), "id")
    )


def feedback_todo(errors: DataFrame, analyses: DataFrame, feedback: DataFrame, as_of: datetime,
                  days: int = 7, require_analysis: bool = True, limit: int | None = 50) -> DataFrame:
    """Recent errors nobody has reviewed, newest first; ``limit`` None lists them all."""
    since = (as_of - timedelta(days=days)).date()
    a = analyses.select(F.col("error_log_id").alias("id"), F.col("id").alias("analysis_id"), *ANALYSIS_COLUMNS)
    # distinct first: an error with very many feedback rows shrinks to one before the shuffle
    reviewed = feedback.select(F.col("error_log_id").alias("id")).distinct()
    open_errors = errors.filter(F.col("dt") >= F.lit(since)).join(reviewed, "id", "left_anti")
    listed = open_errors.join(a, "id", "inner" if require_analysis else "left").orderBy(
        F.col("ts").desc(), "id", "analysis_id")
    return listed if limit is None else listed.limit(limit)


def training_rows(errors: DataFrame, analyses: DataFrame, feedback: DataFrame, min_rating: int = 3) -> DataFrame:
    """Rated feedback with its error and, if any, the analysis it refers to, newest first."""
    e = errors.select(F.col("id").alias("error_log_id"), "log_context", "error_message", "dag_id", "task_id")
    a = analyses.select(F.col("id").alias("ai_analysis_id"), F.col("extracted_error").alias("original_analysis"))
    return (
        feedback.filter(F.col("user_rating") >= min_rating)
        .join(e, "error_log_id").join(a, "ai_analysis_id", "left")
        .select("id", "log_context", "error_message", "dag_id", "task_id", "original_analysis",
                *FEEDBACK_COLUMNS, "feedback_ts")
        .orderBy(F.col("feedback_ts").desc(), "id")
    )


def unanalysed(errors: DataFrame, analyses: DataFrame) -> DataFrame:
    """Errors without any analysis, counted per task."""
    missing = errors.join(analyses.select(F.col("error_log_id").alias("id")).distinct(), "id", "left_anti")
    return missing.groupBy("dag_id", "task_id").agg(F.count("*").alias("error_count")).orderBy(
        F.col("error_count").desc(), "dag_id", "task_id")


def error_listing(errors: DataFrame, analyses: DataFrame, feedback: DataFrame, as_of: datetime, days: int = 7,
                  category: str | None = None, dag_id: str | None = None,
                  show_analyzed: bool = True, show_feedback: bool = True) -> DataFrame:
    """Recent errors with analysis and feedback marks; one row per error however many rows refer to it."""
    analysed = analyses.groupBy(F.col("error_log_id").alias("id")).agg(
        F.min("predicted_category").alias("category"), F.lit(True).alias("analysed"))
    reviewed = feedback.groupBy(F.col("error_log_id").alias("id")).agg(F.lit(True).alias("reviewed"))
    recent = errors.filter(F.col("dt") >= F.lit((as_of - timedelta(days=days)).date()))
    if dag_id is not None:
        recent = recent.filter(F.col("dag_id") == dag_id)
    listed = recent.join(analysed, "id", "left").join(reviewed, "id", "left").select(
        "id", "dt", F.left("dag_id", F.lit(20)).alias("dag_id"), F.left("task_id", F.lit(20)).alias("task_id"),
        F.coalesce("category", F.lit("Unknown")).alias("category"),
        F.coalesce("analysed", F.lit(False)).alias("has_analysis"),
        F.coalesce("reviewed", F.lit(False)).alias("has_feedback"))
    if category is not None:
        listed = listed.filter(F.col("category") == category)
    if not show_analyzed:
        listed = listed.filter(~F.col("has_analysis"))
    if not show_feedback:
        listed = listed.filter(~F.col("has_feedback"))
    return listed


# ---------------------------------------------------------------- statistics


def _counts_map(rows: DataFrame, name: str) -> Column:
    """Scalar map name -> count. The key set is a category list, so the map stays small."""
    counts = rows.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, "n"))))).scalar()


def feedback_stats(feedback: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Counts since a date, average rating, counts per corrected category and the last seven days."""
    since = F.lit((as_of - timedelta(days=days)).date()).cast("timestamp_ntz")
    week = F.lit((as_of - timedelta(days=7)).date()).cast("timestamp_ntz")
    recent = feedback.filter(F.col("feedback_ts") >= since)
    # The seven-day count has its own cut-off and may reach further back than ``days``.
    inside = F.col("feedback_ts") >= since
    return feedback.filter(F.col("feedback_ts") >= F.least(since, week)).agg(
        F.count_if(inside).alias("total_feedback_count"),
        F.coalesce(text.round_half_up(F.avg(F.when(inside, F.col("user_rating"))), 2), F.lit(0.0)).alias("avg_user_rating"),
        F.count_if(F.col("feedback_ts") >= week).alias("recent_feedback_count"),
    ).withColumn("category_distribution", _counts_map(recent, "corrected_category"))


def feedback_stats_all(feedback: DataFrame, as_of: datetime) -> DataFrame:
    """Statistics over every record: average over all rows, strict seven-day boundary."""
    week = F.lit(as_of - timedelta(days=7)).cast("timestamp_ntz")
    average = F.try_divide(F.sum("user_rating"), F.count("*"))
    return feedback.agg(
        F.count("*").alias("total_feedback_count"),
        F.coalesce(text.round_half_up(average, 2), F.lit(0.0)).alias("avg_user_rating"),
        F.count_if(F.col("feedback_ts") > week).alias("recent_feedback_count"),
    ).withColumn("category_distribution", _counts_map(feedback, "corrected_category"))


def category_share(feedback: DataFrame) -> DataFrame:
    """Count and percentage per corrected category; the window runs over the few aggregated rows only."""
    counts = feedback.filter(F.col("corrected_category").isNotNull()).groupBy("corrected_category").agg(
        F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("corrected_category", "n",
                         text.round_half_up(F.col("n") / total * 100, 1).alias("percent")).orderBy("corrected_category")


def progress(errors: DataFrame, analyses: DataFrame, feedback: DataFrame, min_rating: int = 3) -> DataFrame:
    """How many errors exist, are analysed, are reviewed; rates in percent."""
    totals = errors.agg(F.count("*").alias("total_errors")).select(
        "total_errors",
        analyses.agg(F.countDistinct("error_log_id")).scalar().alias("analyzed_errors"),
        feedback.agg(F.countDistinct("error_log_id")).scalar().alias("feedback_errors"),
        feedback.agg(F.count_if(F.col("user_rating") >= min_rating)).scalar().alias("quality_feedback"),
    )

    def rate(part: str) -> Column:
        share = F.try_divide(F.col(part), F.col("total_errors")) * 100
        return F.coalesce(text.round_half_up(share, 1), F.lit(0.0))

    return totals.withColumns({"analysis_rate": rate("analyzed_errors"), "feedback_rate": rate("feedback_errors")})


def top_categories(feedback: DataFrame, since: datetime) -> DataFrame:
    return (
        feedback.filter(F.col("feedback_ts") >= F.lit(since).cast("timestamp_ntz"))
        .groupBy("corrected_category").agg(F.count("*").alias("n"))
        .orderBy(F.col("n").desc(), "corrected_category")
    )


def recent_feedback(feedback: DataFrame, limit: int = 10) -> DataFrame:
    """The newest records and, on each, how many there are in all."""
    total = feedback.agg(F.count("*")).scalar()
    return feedback.withColumn("total_count", total).orderBy(F.col("feedback_ts").desc(), "id").limit(limit)


def auto_export_due(feedback: DataFrame, as_of: datetime, threshold: int = fv.AUTO_EXPORT_THRESHOLD) -> DataFrame:
    week = F.lit((as_of - timedelta(days=7)).date()).cast("timestamp_ntz")
    return feedback.agg(F.count_if(F.col("feedback_ts") >= week).alias("recent_feedback_count")).withColumn(
        "export_due", F.col("recent_feedback_count") >= threshold)


def user_feedback(feedback: DataFrame, user: str) -> DataFrame:
    """All records of one user with their number; the count is a scalar, not a window over a hot user."""
    own = feedback.filter(F.col("reviewer") == user)
    return own.withColumn("feedback_count", own.agg(F.count("*")).scalar())


def feedback_on(feedback: DataFrame, day: date) -> DataFrame:
    return feedback.filter(F.to_date("feedback_ts") == F.lit(day))


def retain_errors(errors: DataFrame, as_of: datetime, retention_days: int) -> DataFrame:
    """Rows a retention run keeps; the date filter prunes partitions."""
    return errors.filter(F.col("dt") >= F.lit((as_of - timedelta(days=retention_days)).date()))


def retain_children(children: DataFrame, kept_errors: DataFrame) -> DataFrame:
    """Analyses or feedback whose error row is kept."""
    return children.join(kept_errors.select(F.col("id").alias("error_log_id")), "error_log_id", "left_semi")


def retention_report(errors: DataFrame, as_of: datetime, retention_days: int) -> DataFrame:
    """Dry run: how many rows would be deleted and kept."""
    keep = F.col("dt") >= F.lit((as_of - timedelta(days=retention_days)).date())
    return errors.agg(F.count_if(~keep).alias("deleted"), F.count_if(keep).alias("kept"))

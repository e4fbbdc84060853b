"""Failure reports over stored analysis records. All are grouped counts with map-side partial aggregation."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv

TOP_DAGS = 5


def daily_stats(records: DataFrame) -> DataFrame:
    """Successful analyses per day with one count per severity."""
    counts = [F.count_if(F.col("severity") == s).alias(f"{s}_failures") for s in reversed(fv.SEVERITIES)]
    return (
        records.filter("success").groupBy(F.to_date("ts").alias("date"))
        .agg(F.count("*").alias("total_failures"), *counts,
             F.avg("processing_time").alias("avg_processing_time"), F.avg("confidence").alias("avg_confidence"))
        .orderBy(F.col("date").desc())
    )


def dag_stats(records: DataFrame) -> DataFrame:
    """Successful analyses per dag. Distinct tasks are reduced per (dag, task) first, so a hot dag is spread."""
    per_task = records.filter("success").groupBy("dag_id", "task_id").agg(
        F.count("*").alias("n"), F.sum("processing_time").alias("seconds"), F.count("processing_time").alias("timed"),
        F.max("ts").alias("last"), F.count_if(F.col("severity").isin(*fv.ALERT_SEVERITIES)).alias("severe"))
    return (
        per_task.groupBy("dag_id")
        .agg(F.sum("n").alias("total_failures"), F.count("*").alias("affected_tasks"),
             F.try_divide(F.sum("seconds"), F.sum("timed")).alias("avg_processing_time"),
             F.max("last").alias("last_failure"), F.sum("severe").alias("severe_failures"))
        .orderBy(F.col("total_failures").desc(), "dag_id")
    )


def category_counts(records: DataFrame) -> Column:
    """Scalar map category -> count; the key set is the category list."""
    counts = records.filter(F.col("category").isNotNull()).groupBy("category").agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "n"))))).scalar()


def top_failing_dags(records: DataFrame, k: int = TOP_DAGS) -> DataFrame:
    return records.groupBy("dag_id").agg(F.count("*").alias("failures")).orderBy(
        F.col("failures").desc(), "dag_id").limit(k)


def _packed_top(records: DataFrame, k: int) -> Column:
    """Scalar array of the k top dags, best first; k bounds its size."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("failures")).alias("rank"), "dag_id", "failures")))
    packed = F.transform(ordered, lambda item: F.struct(item["dag_id"].alias("dag_id"), item["failures"].alias("failures")))
    return top_failing_dags(records, k).agg(packed).scalar()


def daily_summary(records: DataFrame, day: date, k: int = TOP_DAGS) -> DataFrame:
    """One day of successful analyses: total, categories, top dags and average time."""
    start = datetime(day.year, day.month, day.day)
    todays = records.filter(F.col("success") & (F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
                            & (F.col("ts") < F.lit(start + timedelta(days=1)).cast("timestamp_ntz")))
    return todays.agg(F.count("*").alias("total_failures"), F.avg("processing_time").alias("average_processing_time")).select(
        F.lit(day).alias("date"), "total_failures", category_counts(todays).alias("categories"),
        _packed_top(todays, k).alias("top_failing_dags"), "average_processing_time")


def dashboard_stats(records: DataFrame, errors: DataFrame, as_of: datetime, days: int = 7, k: int = TOP_DAGS) -> DataFrame:
    """Totals of the last days, resolution rate, categories and top dags."""
    since = F.lit(as_of - timedelta(days=days)).cast("timestamp_ntz")
    last_day = F.lit(as_of - timedelta(days=1)).cast("timestamp_ntz")
    recent = records.filter(F.col("ts") >= since)
    resolution = errors.filter(F.col("ts") >= since).agg(
        F.coalesce(F.try_divide(F.count_if("resolved"), F.count("*")), F.lit(0.0))).scalar()
    return recent.agg(
        F.count("*").alias("total_failures"), F.count_if(F.col("ts") >= last_day).alias("today_failures"),
        F.coalesce(F.avg("processing_time"), F.lit(0.0)).alias("average_processing_time"),
    ).select("*", resolution.alias("resolution_rate"), category_counts(recent).alias("error_categories"),
             _packed_top(recent, k).alias("top_failing_dags"), F.lit(days).alias("period_days"))


def trends(errors: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Failures and resolved failures per day; days without failures are listed with zeros."""
    first = (as_of - timedelta(days=days)).date()
    last = first + timedelta(days=days - 1)
    spark = errors.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(
        F.lit(first), F.lit(last), F.expr("interval 1 day"))).alias("date"))
    counts = errors.filter(F.col("dt").between(F.lit(first), F.lit(last))).groupBy(F.col("dt").alias("date")).agg(
        F.count("*").alias("failures"), F.count_if("resolved").alias("resolved"))
    return calendar.join(counts, "date", "left").select(
        "date", F.coalesce("failures", F.lit(0)).alias("failures"),
        F.coalesce("resolved", F.lit(0)).alias("resolved")).orderBy("date")


def recent_failures(records: DataFrame, limit: int = 10) -> DataFrame:
    return records.select("id", "dag_id", "task_id", "run_id", "ts", "error_message", "category", "severity").orderBy(
        F.col("ts").desc(), "id").limit(limit)


def timeline(records: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Failures of the last hours in time order."""
    since = F.lit(as_of - timedelta(hours=hours)).cast("timestamp_ntz")
    return records.filter(F.col("ts") >= since).select("id", "ts", "dag_id", "task_id", "severity", "category").orderBy("ts", "id")


def health_from_counts(recent: Column, week: Column) -> Column:
    """Score, status and trend from the failures of the last day and of the last week."""
    average = week / 7
    score = F.when(average == 0, F.lit(100.0)).otherwise(
        F.greatest(F.lit(0.0), 100 - F.coalesce(F.try_divide(recent, average), F.lit(0.0)) * 20))
    status = (F.when(score >= 90, "excellent").when(score >= 70, "good").when(score >= 50, "warning").otherwise("critical"))
    trend = F.when(recent < average, "improving").when(recent == average, "stable").otherwise("degrading")
    return F.struct(score.cast("int").alias("health_score"), status.alias("status"),
                    recent.alias("recent_failures"), trend.alias("trend"))


def health(records: DataFrame, as_of: datetime) -> DataFrame:
    week = F.lit(as_of - timedelta(days=7)).cast("timestamp_ntz")
    day = F.lit(as_of - timedelta(days=1)).cast("timestamp_ntz")
    counts = records.filter(F.col("ts") >= week).agg(
        F.count_if(F.col("ts") >= day).alias("recent"), F.count("*").alias("week"))
    return counts.select(health_from_counts(F.col("recent"), F.col("week")).alias("h")).select("h.*")


def monitor_stats(records: DataFrame) -> DataFrame:
    """Processed results, total and average processing time, last check."""
    return records.agg(
        F.count("*").alias("processed"), F.countDistinct("dag_id", "task_id", "run_id").alias("failed_tasks_found"),
        F.coalesce(F.sum("processing_time"), F.lit(0.0)).alias("total_processing_time"),
        F.coalesce(F.try_divide(F.sum("processing_time"), F.count("*")), F.lit(0.0)).alias("average_processing_time"),
        F.max("ts").alias("last_check"))

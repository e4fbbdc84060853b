"""Continuous forms of the failure analysis. Watermarks bound all state; sinks are idempotent per batch, keyed tables are compacted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tasklore.operators import alerts
from tasklore.schemas import TASK_KEY, TRY_KEY
from tasklore.sources.keyed_store import KeyedStore

EVENT_TIME = "event_time"


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet",
                files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of one table as a stream; the pattern selects the table in a shared folder."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def with_event_time(stream: DataFrame, source: str = "start_date", delay: str = "1 day") -> DataFrame:
    """Watermarked event time. Watermarks need a zoned timestamp, so naive times are cast first."""
    return stream.withColumn(EVENT_TIME, F.col(source).cast("timestamp")).withWatermark(EVENT_TIME, delay)


def failed_tries(tries: DataFrame) -> DataFrame:
    """Failed tries as they arrive."""
    return tries.filter((F.col("state") == "failed") & (F.col("try_number") > 0))


def once_per_try(tries: DataFrame) -> DataFrame:
    """Each try once, however often overlapping polls deliver it; the watermark bounds the keys kept."""
    return tries.dropDuplicatesWithinWatermark(TRY_KEY)


def windowed_counts(failures: DataFrame, window: Column) -> DataFrame:
    """Failures per dag and window (tumbling, sliding or session)."""
    return failures.groupBy("dag_id", window.alias("w")).agg(F.count("*").alias("failures")).select(
        "dag_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "failures")


def tumbling(size: str = "1 day") -> Column:
    return F.window(EVENT_TIME, size)


def sliding(size: str = "1 hour", slide: str = "15 minutes") -> Column:
    return F.window(EVENT_TIME, size, slide)


def session(gap: str = "30 minutes") -> Column:
    return F.session_window(EVENT_TIME, gap)


def daily_stats(results: DataFrame, seconds: str = "processing_time") -> DataFrame:
    """Processed results, total and average time per day; a new day is a new window, so nothing is reset."""
    return results.groupBy(tumbling().alias("w")).agg(
        F.count("*").alias("processed"), F.sum(seconds).alias("total_processing_time"),
        F.avg(seconds).alias("average_processing_time"),
    ).select(F.col("w.start").alias("day"), "processed", "total_processing_time", "average_processing_time")


# ---------------------------------------------------------------- sinks


def _start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str,
           trigger: dict) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**trigger).start()


def to_batches(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
               transform: Callable[[DataFrame], DataFrame] = lambda batch: batch,
               trigger: dict | None = None) -> StreamingQuery:
    """Write every micro-batch to its own ``batch_id`` folder; a replayed batch overwrites only itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(stream, write, checkpoint, mode, trigger or {"availableNow": True})


def to_store(stream: DataFrame, store: KeyedStore, checkpoint: str, mode: str = "update", trigger: dict | None = None) -> StreamingQuery:
    """Merge every micro-batch into a keyed table. In ``update`` mode a batch holds the keys it changed, in ``append`` mode those that are final;
    in both, state behind the watermark is dropped and late rows are left out."""
    return _start(stream, lambda batch, batch_id: store.apply(batch, batch_id) and None, checkpoint, mode, trigger or {"availableNow": True})


def window_store(spark: SparkSession, path: str, compact_every: int = 16) -> KeyedStore:
    """Counts by dag and window; the newest count of a window holds."""
    schema = StructType.fromDDL("dag_id string, window_start timestamp, window_end timestamp, failures bigint")
    return KeyedStore(spark, path, schema, ["dag_id", "window_start", "window_end"], compact_every=compact_every)


def stats_store(spark: SparkSession, path: str, compact_every: int = 16) -> KeyedStore:
    """Daily statistics, one row a day."""
    schema = StructType.fromDDL("day timestamp, processed bigint, total_processing_time double, average_processing_time double")
    return KeyedStore(spark, path, schema, ["day"], compact_every=compact_every)


def baseline_store(spark: SparkSession, path: str, compact_every: int = 16) -> KeyedStore:
    """Template counts by task: sizes add up, the newest time holds."""
    schema = StructType.fromDDL("dag_id string, task_id string, template string, size bigint, last_updated timestamp_ntz")
    return KeyedStore(spark, path, schema, [*TASK_KEY, "template"], {"size": F.sum, "last_updated": F.max}, compact_every)


def latest_batch(spark: SparkSession, path: str) -> DataFrame:
    """Result of a complete-mode stream: the rows of its last batch."""
    stored = spark.read.parquet(path)
    return stored.filter(F.col("batch_id") == stored.agg(F.max("batch_id")).scalar()).drop("batch_id")


def to_results(results: DataFrame, path: str, checkpoint: str, patterns: dict, default: list,
               trigger: dict | None = None) -> StreamingQuery:
    """Results, alert rows and update events of every micro-batch, each below its ``batch_id``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            outputs = {
                "results": batch,
                "alerts": alerts.with_recipients(alerts.alert_results(batch), patterns, default),
                "events": alerts.completed_analyses(batch),
            }
            for name, rows in outputs.items():
                rows.write.mode("overwrite").parquet(f"{path}/{name}/batch_id={batch_id}")
        finally:
            batch.unpersist()

    return _start(results, write, checkpoint, "append", trigger or {"availableNow": True})


def grow_baseline(lines: DataFrame, store: KeyedStore, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Incremental baseline: every batch adds its own template counts to a ``baseline_store``; a batch delivered again adds nothing.

    ``lines`` has dag_id, task_id, template and ts.
    """
    def add(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch.groupBy(*TASK_KEY, "template").agg(F.count("*").alias("size"), F.max("ts").alias("last_updated")), batch_id)

    return _start(lines, add, checkpoint, "append", trigger or {"availableNow": True})


def unknown_lines(lines: DataFrame, baseline: DataFrame) -> DataFrame:
    """Stream of lines whose template the stored baseline lacks (stream-static left join, null kept)."""
    known = baseline.select(*TASK_KEY, "template").distinct().withColumn("known", F.lit(True))
    return lines.join(known, [*TASK_KEY, "template"], "left").filter(F.col("known").isNull()).drop("known")

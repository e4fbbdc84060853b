"""Writers. Appends go to Parquet partitioned by date, exports to JSON lines or CSV."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def store_error_logs(errors: DataFrame, path: str) -> None:
    """Append error rows; the date is derived from the time and becomes the partition column."""
    rows = errors.withColumn("date", F.to_date("ts"))
    rows.repartition("date", F.pmod(F.xxhash64("id"), F.lit(64))).write.partitionBy("date").mode("append").parquet(path)


def store_analyses(analyses: DataFrame, path: str) -> None:
    """Append analyses with their model version as JSON metadata."""
    metadata = F.to_json(F.struct(F.coalesce("model_version", F.lit("v1.0")).alias("model_version")))
    analyses.withColumn("analysis_metadata", metadata).write.mode("append").parquet(path)


def feedback_id(feedback: DataFrame, ts: str = "feedback_ts") -> DataFrame:
    """Add the record id ``dag_task_epoch``."""
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(ts))
    return feedback.withColumn("feedback_id", F.concat_ws("_", "dag_id", "task_id", seconds))


def store_feedback(feedback: DataFrame, path: str) -> None:
    feedback.write.mode("append").parquet(path)


def store_feedback_records(records: DataFrame, path: str) -> None:
    """Append nested feedback records as JSON lines."""
    records.write.mode("append").json(path, ignoreNullFields=False)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.json(path, ignoreNullFields=False)


def write_json_arrays(rows: DataFrame, path: str, key: str, rows_per_document: int = 10_000) -> None:
    """JSON array documents of bounded size, rows spread over them by a hash of the key.

    An array has to be put together in one place, so the number of documents grows with the rows.
    """
    documents = max(1, math.ceil(rows.count() / rows_per_document))
    text = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    numbered = rows.select(F.pmod(F.xxhash64(key), F.lit(documents)).alias("document"), text.alias("row"))
    arrays = numbered.groupBy("document").agg(F.array_join(F.collect_list("row"), ",\n").alias("body"))
    arrays.select("document", F.concat(F.lit("[\n"), "body", F.lit("\n]")).alias("value")).write.partitionBy("document").text(path)


def pack_logs(logs: DataFrame, path: str, key: str, pack_bytes: int = 64 * 1024 * 1024) -> DataFrame:
    """Many logs a file: texts put together into packs of about ``pack_bytes``, one text file each below ``path/pack=``.

    Returns the manifest ``key, pack, log_offset, log_length`` (bytes), which is all a reader needs to take one log out of its pack.
    A pack is put together in one place, so their number grows with the bytes; one longer log makes a longer pack.
    """
    texts = logs.select(key, F.coalesce("log_content", F.lit("")).alias("log_content"))
    total = texts.agg(F.sum(F.octet_length("log_content"))).first()[0] or 0
    packs = max(1, math.ceil(total / pack_bytes))
    numbered = texts.withColumn("pack", F.pmod(F.xxhash64(key), F.lit(packs)))
    bodies = numbered.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct(key, "log_content"))).alias("logs"))
    bodies.select("pack", F.array_join(F.transform("logs", lambda one: one["log_content"]), "\n").alias("value")).write.partitionBy("pack").text(path)
    before = Window.partitionBy("pack").orderBy(key, "log_length").rowsBetween(Window.unboundedPreceding, -1)
    lengths = numbered.select(key, "pack", F.octet_length("log_content").cast("long").alias("log_length"))
    return lengths.withColumn("log_offset", F.coalesce(F.sum(F.col("log_length") + 1).over(before), F.lit(0))).select(key, "pack", "log_offset", "log_length")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True, nullValue="", emptyValue="", escape='"', quoteAll=False,
                   ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def save_examples(examples: DataFrame, path: str) -> None:
    """Training examples as JSON lines."""
    examples.write.json(path, ignoreNullFields=False)


def store_baseline(baseline: DataFrame, path: str, version: int) -> None:
    """Write a whole baseline table as one version. Refreshing, retiring and clearing all produce the next
    version from the last one; a repeated write replaces only itself, and readers keep what they opened."""
    baseline.write.mode("overwrite").parquet(f"{path}/version={version}")


def latest_baseline(spark: SparkSession, path: str) -> DataFrame:
    """The newest stored version; the version filter prunes the other folders."""
    stored = spark.read.parquet(path)
    newest = stored.agg(F.max("version")).first()[0]
    return stored.filter(F.col("version") == newest).drop("version")

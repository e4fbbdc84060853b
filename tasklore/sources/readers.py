"""Readers. Schemas are given, never inferred."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tasklore import schemas
from tasklore.operators.candidates import from_log_lines
from tasklore.operators.sizing import join_measured

MAX_LIST_BYTES = 64 * 1024 * 1024
ROWS_PER_TASK = 50_000


def jdbc_tasks(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Task rows from a metadata store; filters and columns are pushed to the store.

    Pass ``partitionColumn``, ``lowerBound``, ``upperBound`` and ``numPartitions`` to read in parallel.
    """
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def spread(rows: DataFrame, *keys: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Rebalance a source before costly per-row work, so that no task gets more than about ``rows_per_task`` rows.

    Partitions say nothing about rows: a row group is read by one task, however many partitions its file is cut into. The rows
    of each partition are counted first, which reads no column. A source whose fullest partition is small enough, or
    no fuller than an even share of the cores, is returned unchanged, without a shuffle.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    sizes = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    total, fullest = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    tasks = max(cores, math.ceil(total / rows_per_task))
    return rows if fullest * tasks <= 2 * total else rows.repartition(tasks, *keys)


def raw_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row per log file: its path and whole text."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("filepath"), F.col("value").alias("log_content"))


def packed_logs(spark: SparkSession, path: str, manifest: DataFrame, key: str) -> DataFrame:
    """Logs taken out of their packs: the manifest's ``key`` and ``log_content``. Only packs that it lists are opened.

    A pack meets the list of its logs once and is cut in its own row, so its content is neither repeated nor shuffled while the lists are small.
    Beyond ``MAX_LIST_BYTES`` the packs are shuffled to their lists: a broadcast of one entry a log would pass through the driver.
    """
    wanted = manifest.groupBy("pack").agg(F.collect_list(F.struct(key, "log_offset", "log_length")).alias("entries"))
    files = spark.read.format("binaryFile").load(path).select(F.col("pack").cast("long").alias("pack"), "content")

    def cut(entry: Column) -> Column:
        raw = F.substring("content", (entry["log_offset"] + 1).cast("int"), entry["log_length"].cast("int"))
        return F.struct(entry[key].alias(key), F.decode(raw, "UTF-8").alias("log_content"))

    return join_measured(files, wanted, ["pack"], "packs-wanted", MAX_LIST_BYTES).select(F.inline(F.transform("entries", cut)))


def packed_manifest(spark: SparkSession, manifest: str, logs: str) -> DataFrame:
    """Manifest rows (CSV, with the pack, offset and length of each log) and the text of their log."""
    schema = "pack long, log_offset long, log_length long, start_date timestamp_ntz, end_date timestamp_ntz, dag_id string, task_id string, run_id string"
    listed = spark.read.csv(manifest, schema=schema, header=True)
    return listed.drop("pack", "log_offset", "log_length").join(packed_logs(spark, logs, listed, "run_id"), "run_id")


def log_manifest(spark: SparkSession, manifest: str, logs: str) -> DataFrame:
    """Manifest rows with the text of their log file. Paths are compared without their scheme."""
    def bare(name: str):
        return F.regexp_replace(F.col(name), "^[a-z0-9]+:/+", "/")

    listed = spark.read.csv(manifest, schema=schemas.LOG_MANIFEST, header=True)
    texts = raw_logs(spark, logs).select(bare("filepath").alias("file_key"), "log_content")
    return listed.withColumn("file_key", bare("filepath")).join(texts, "file_key", "left").drop("file_key")


def candidate_lines(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """JSON lines of (candidates, error) as candidates; malformed or empty rows are skipped.

    ``limit`` counts lines from the start of the input, skipped ones included, as the feature asks.
    """
    lines = spark.read.text(path)
    if limit:
        lines = lines.limit(limit)
    options = {"columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = lines.select(F.from_json("value", schemas.CANDIDATE_LINE, options).alias("row")).select("row.*")
    return from_log_lines(parsed.filter(F.col("_corrupt_record").isNull()))


def feedback_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FEEDBACK_RECORD).json(path)


def json_arrays(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of JSON array documents: one file, or a folder of them."""
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.select(*schema.names)


def csv_export(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Text columns of a CSV export; what is missing is an empty text, as it was written."""
    rows = spark.read.csv(path, schema=schema, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return rows.select(*[F.coalesce(name, F.lit("")).alias(name) for name in schema.names])


def reviewed_rows(spark: SparkSession, path: str) -> DataFrame:
    """JSON array documents of reviewed rows: one file, or a folder of them."""
    rows = spark.read.schema(schemas.REVIEWED_ROW).option("multiLine", True).option("recursiveFileLookup", True).json(path)
    return rows.select(*schemas.REVIEWED_ROW.names)


def training_examples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.TRAINING_EXAMPLE).json(path)

"""Exact global positions without a single-partition window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tasklore.session import scratch_path


def with_position(rows: DataFrame, *order: str, partitions: int | None = None) -> DataFrame:
    """Add ``position`` (0-based rank by unique ``order`` columns) and ``total``.

    Rows are range-partitioned and written once to the shared folder together with the number of their
    range, so the ranges stay the same when a task is retried. Each range is ranked on its own and moved
    by the number of rows in the ranges before it; that table has one row per range.
    """
    spark = rows.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_path(spark, "ranges")
    ranged = rows.repartitionByRange(count, *order).withColumn("range_no", F.spark_partition_id())
    ranged.write.parquet(path)
    stored = spark.read.schema(ranged.schema).parquet(path)
    sizes = stored.groupBy("range_no").agg(F.count("*").alias("n"))
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"),
                           F.sum("n").over(everything).alias("total"))
    inside = Window.partitionBy("range_no").orderBy(*order)
    return (
        stored.join(F.broadcast(offsets), "range_no")  # one row per range
        .withColumn("position", F.col("skipped") + F.row_number().over(inside) - 1)
        .drop("range_no", "skipped")
    )

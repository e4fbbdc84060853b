"""Helpers shared by the operators: scratch tables, stable sampling, unordered rows in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tasklore.session import scratch_path

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXT_ROWS = 1_000
HASHES = 1 << 40
STRETCHES = 256


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Read the named columns of an input table; a column the table lacks is an error, others are not read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def written(rows: DataFrame, name: str) -> DataFrame:
    """Write rows once below ``spark.checkpoint.dir`` and read them back: cuts the lineage and survives lost executors."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def kept_names(columns: list[str]) -> list[str]:
    return [f"kept_{number}" for number in range(len(columns))]


def packed(rows: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all columns of the table under names that can't clash with those of an operator."""
    return rows.select(*names, *[rows[name].alias(kept) for name, kept in zip(rows.columns, kept_names(rows.columns), strict=True)])


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that ``packed`` kept under their own names; ``changed`` gives new values."""
    return rows.select(*[changed.get(name, F.col(kept)).alias(name) for name, kept in zip(columns, kept_names(columns), strict=True)])


def id_remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def smallest_hashes(rows: DataFrame, label: str, per_label: int | Column, key: str = "doc_id") -> DataFrame:
    """At most ``per_label`` rows of each label, those with the smallest key hash: bounded, and the same on every run.

    Labels are counted first, and only hashes below the share that leaves about four times as many rows are looked at. They are
    counted by stretches of the hash: stretches that fit are taken whole, and only the one in which ``per_label`` is reached is
    ranked, so no task ranks a label. Both counts are broadcast: one row a label, and at most ``STRETCHES`` rows a label.
    """
    wanted = per_label if isinstance(per_label, Column) else F.lit(per_label)
    place = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(HASHES))
    sizes = rows.groupBy(F.col(label).alias("counted_label")).agg(F.count("*").alias("label_rows"))
    share = F.least(F.lit(float(HASHES)) * 4 * wanted / F.col("label_rows"), F.lit(float(HASHES)))
    near = rows.join(F.broadcast(sizes), F.col(label) == F.col("counted_label")).filter(place < share).withColumn(
        "stretch", F.floor(place * STRETCHES / share))
    counts = near.groupBy("counted_label", "stretch").agg(F.count("*").alias("stretch_rows"), F.first(wanted).alias("wanted"))
    upto = F.sum("stretch_rows").over(Window.partitionBy("counted_label").orderBy("stretch"))
    counts = counts.withColumn("room", F.col("wanted") - upto + F.col("stretch_rows")).filter("room > 0").drop("wanted")
    fits = near.join(F.broadcast(counts), ["counted_label", "stretch"])
    whole, cut = fits.filter("stretch_rows <= room"), fits.filter("stretch_rows > room")
    ordered = Window.partitionBy("counted_label").orderBy(place, key)
    ranked = cut.withColumn("sample_rank", F.row_number().over(ordered)).filter(F.col("sample_rank") <= F.col("room"))
    return whole.select(*rows.columns).union(ranked.select(*rows.columns))


def texts_for_python(rows: DataFrame) -> DataFrame:
    """The rows, and a session that sends them to Python in Arrow batches of at most ``TEXT_ROWS`` rows; a smaller setting stays.

    Whole texts are large, and an executor holds a batch several times for each task: as rows, in Arrow on both sides, as Python strings.
    """
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(BATCH_ROWS)) <= TEXT_ROWS:
        conf.set(BATCH_ROWS, TEXT_ROWS)
    return rows


def give_back() -> None:
    """Return the memory that Arrow keeps for later batches. Spark keeps idle Python workers, and each would hold its share for good."""
    pa.default_memory_pool().release_unused()


def strings(batch, name: str) -> list[str | None]:
    """A string column of an Arrow batch as Python values."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()

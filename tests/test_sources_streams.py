"""Files and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tasklore import session
from tasklore.operators import baseline
from tasklore.sources import readers, writers
from tasklore.streaming import failures as stream

AS_OF = datetime(2024, 1, 31)


def test_raw_logs_and_manifest(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("one\n\ntwo")
    (tmp_path / "logs" / "b.log").write_text("three")
    (tmp_path / "m.csv").write_text(
        "filepath,start_date,end_date,dag_id,task_id,run_id\n"
        f"{tmp_path}/logs/a.log,2024-01-01 00:00:00,2024-01-01 00:01:00,d,t,r1\n"
        f"{tmp_path}/logs/gone.log,2024-01-01 00:00:00,2024-01-01 00:01:00,d,t,r2\n")
    assert readers.raw_logs(spark, str(tmp_path / "logs")).count() == 2
    rows = {r["run_id"]: r["log_content"] for r in readers.log_manifest(spark, str(tmp_path / "m.csv"), str(tmp_path / "logs")).collect()}
    assert rows == {"r1": "one\n\ntwo", "r2": None}


def test_packed_logs_come_back_whole(spark, tmp_path):
    texts = {"r1": "one\n\ntwo", "r2": "", "r3": "é日本\n", "r4": None, "r5": "x" * 5000, "r6": "\r\nend"}
    manifest = writers.pack_logs(spark.createDataFrame(list(texts.items()), "run_id string, log_content string"), str(tmp_path / "p"), "run_id", 2000)
    found = {r["run_id"]: r["log_content"] for r in readers.packed_logs(spark, str(tmp_path / "p"), manifest, "run_id").collect()}
    assert found == {key: text or "" for key, text in texts.items()}
    some = manifest.filter("run_id in ('r3', 'r5')")
    assert {r["run_id"] for r in readers.packed_logs(spark, str(tmp_path / "p"), some, "run_id").collect()} == {"r3", "r5"}
    assert len(list((tmp_path / "p").glob("pack=*"))) > 1


def test_candidate_lines_skip_and_limit(spark, tmp_path):
    lines = [json.dumps({"candidates": "DAG_ID='d1' TASK_ID: t1, DAG_RUN_ID=\"x\"", "error": "e1"}), "{broken", json.dumps({"candidates": "", "error": "e"}),
             json.dumps({"candidates": "c", "error": "e2"}), json.dumps({"candidates": "c", "error": "e3"})]
    path = tmp_path / "c.jsonl"
    path.write_text("\n".join(lines))
    found = readers.candidate_lines(spark, str(path), limit=4).collect()
    assert sorted(r["error_message"] for r in found) == ["e1", "e2"]
    first = next(r for r in found if r["error_message"] == "e1")
    assert (first["dag_id"], first["task_id"], first["run_id"]) == ("d1", "t1", "x")
    assert readers.candidate_lines(spark, str(path)).count() == 3


def test_reviewed_array_document(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps([{"id": "1", "raw_logs": "l", "human_feedback": " f ", "status": "approved"}, {"id": "2", "status": "pending"}], indent=2))
    assert {r["id"]: r["human_feedback"] for r in readers.reviewed_rows(spark, str(path)).collect()} == {"1": " f ", "2": None}


def test_csv_export_writes_empty_texts(spark, tmp_path):
    frame = spark.createDataFrame([("a", None), ("b", "x,y")], "id string, note string")
    writers.write_csv(frame.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert text == ["id,note", "a,", 'b,"x,y"']


def test_error_logs_are_partitioned_and_appended(spark, tmp_path):
    frame = spark.createDataFrame([(1, datetime(2024, 1, 1, 5)), (2, datetime(2024, 1, 2, 5))], "id int, ts timestamp_ntz")
    for _ in range(2):
        writers.store_error_logs(frame, str(tmp_path / "e"))
    stored = spark.read.parquet(str(tmp_path / "e"))
    assert stored.count() == 4 and {str(r["date"]) for r in stored.select("date").distinct().collect()} == {"2024-01-01", "2024-01-02"}


def test_baseline_versions(spark, tmp_path):
    one = spark.createDataFrame([("d", "t", "a"), ("e", "t", "b")], "dag_id string, task_id string, template string")
    writers.store_baseline(one, str(tmp_path / "b"), 1)
    writers.store_baseline(baseline.clear(writers.latest_baseline(spark, str(tmp_path / "b")), "d", "t"), str(tmp_path / "b"), 2)
    assert [tuple(r) for r in writers.latest_baseline(spark, str(tmp_path / "b")).collect()] == [("e", "t", "b")]


def test_scratch_paths_are_new_and_shared(spark):
    one, two = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert one != two and one.startswith(spark.conf.get(session.CHECKPOINT_KEY).rstrip("/"))


# ---------------------------------------------------------------- streams

SCHEMA = "dag_id string, task_id string, run_id string, try_number int, state string, start_date timestamp_ntz"


def write_poll(spark, folder, numbers, day=1):
    rows = [("d", "t", f"r{n}", 1, "failed" if n % 2 else "success", datetime(2024, 1, day) + timedelta(minutes=n)) for n in numbers]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def test_overlapping_polls_count_each_try_once(spark, tmp_path):
    folder = tmp_path / "in"
    schema = spark.createDataFrame([], SCHEMA).schema
    write_poll(spark, folder, range(10))

    def poll():
        tries = stream.with_event_time(stream.failed_tries(stream.file_stream(spark, str(folder), schema, files_per_batch=1)))
        stream.to_batches(stream.once_per_try(tries), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert poll() == 5
    write_poll(spark, folder, range(5, 15))  # overlaps the first poll
    assert poll() == 7


def test_replayed_batch_overwrites_itself(spark, tmp_path):
    frame = spark.range(3)
    for _ in range(2):
        frame.write.mode("overwrite").parquet(str(tmp_path / "out" / "batch_id=0"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_baseline_grows_by_batches(spark, tmp_path):
    schema = "dag_id string, task_id string, template string, ts timestamp_ntz"
    store = stream.baseline_store(spark, str(tmp_path / "out"))
    for day in (1, 2):
        spark.createDataFrame([("d", "t", "a", datetime(2024, 1, day))] * day, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        lines = stream.file_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        stream.grow_baseline(lines, store, str(tmp_path / "state")).awaitTermination()
    row = store.read().first()
    assert (row["size"], row["last_updated"]) == (3, datetime(2024, 1, 2))


def test_unknown_lines(spark):
    lines = spark.createDataFrame([("d", "t", "a"), ("d", "t", "b"), ("e", "t", "a")], "dag_id string, task_id string, template string")
    known = spark.createDataFrame([("d", "t", "a"), ("d", "t", "a")], "dag_id string, task_id string, template string")
    assert {tuple(r) for r in stream.unknown_lines(lines, known).collect()} == {("d", "t", "b"), ("e", "t", "a")}


@pytest.mark.parametrize("batches", [1, 3])
def test_windows_do_not_depend_on_batches(spark, tmp_path, batches):
    folder = tmp_path / "in"
    for part in range(3):
        write_poll(spark, folder, range(part * 100, part * 100 + 100))
    schema = spark.createDataFrame([], SCHEMA).schema
    source = stream.file_stream(spark, str(folder), schema, files_per_batch=4 - batches)
    counts = stream.windowed_counts(stream.with_event_time(stream.failed_tries(source)), stream.sliding())
    stream.to_batches(counts, str(tmp_path / "out"), str(tmp_path / "state"), "complete").awaitTermination()
    got = {tuple(r) for r in stream.latest_batch(spark, str(tmp_path / "out")).select("window_start", "failures").collect()}
    batch = stream.windowed_counts(spark.read.parquet(str(folder)).filter("state = 'failed'").withColumn("event_time", F.col("start_date").cast("timestamp")), stream.sliding())
    assert got == {tuple(r) for r in batch.select("window_start", "failures").collect()}


def test_rows_of_one_row_group_are_spread_however_many_partitions_there_are(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(40_000).select("id", F.repeat(F.col("id").cast("string"), 20).alias("text")).coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
        table = spark.read.parquet(path)
        assert table.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        sizes = [row.n for row in readers.spread(table, "id", rows_per_task=1000).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 40_000 and max(sizes) < 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    even = spark.range(0, 4000, 1, 4)
    assert readers.spread(even, "id") is even and readers.spread(even.filter("id < 0"), "id").count() == 0


def test_packs_are_cut_alike_when_their_lists_are_too_long_to_broadcast(spark, tmp_path, monkeypatch):
    texts = spark.range(300).select(F.concat(F.lit("r"), "id").alias("run_id"), F.repeat(F.col("id").cast("string"), 30).alias("log_content"))
    manifest = writers.pack_logs(texts, str(tmp_path / "p"), "run_id", 2000)
    monkeypatch.setattr(readers, "MAX_LIST_BYTES", 1000)
    found = readers.packed_logs(spark, str(tmp_path / "p"), manifest, "run_id")
    assert sorted(found.collect()) == sorted(texts.collect())
    assert "strategy=broadcast" not in found._jdf.queryExecution().optimizedPlan().toString()

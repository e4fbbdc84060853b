"""Keyed tables that grow by batches, stored baselines, and the streams that write them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tasklore.operators import baseline, logs, novelty, stored_baselines, template_tree
from tasklore.plans import monitoring
from tasklore.schemas import TRY_KEY
from tasklore.sources.keyed_store import KeyedStore
from tasklore.streaming import failures as stream
from tasklore.streaming import tree_state

AS_OF = datetime(2024, 1, 31)
RUN = "dag_id string, task_id string, run_id string, try_number int, state string, start_date timestamp_ntz, end_date timestamp_ntz, log_content string"
SCHEMA = StructType([StructField("key", StringType()), StructField("value", IntegerType())])


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def content(store):
    return sorted(map(tuple, store.read().collect()))


def files(path):
    return [one for one in path.rglob("*") if one.is_file() and not one.name.startswith(".")]


def test_newest_value_of_a_key_holds_and_replays_change_nothing(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), SCHEMA, ["key"], compact_every=3)
    assert content(store) == []
    assert store.apply(rows(spark, ("a", 1), ("b", 1)), 0) and not store.apply(rows(spark, ("a", 9)), 0)
    store.apply(rows(spark, ("a", 2)), 1)
    assert content(store) == [("a", 2), ("b", 1)]
    store.apply(rows(spark, ("c", None)), 2)  # compacts
    assert store.manifest().changes == {} and content(store) == [("a", 2), ("b", 1), ("c", None)]
    assert not store.apply(rows(spark, ("b", 9)), 1)  # inside the base
    store.apply(rows(spark, ("b", 3)), store.next_batch())
    assert content(store) == [("a", 2), ("b", 3), ("c", None)]


def test_sums_and_the_number_of_files_is_bounded(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), SCHEMA, ["key"], {"value": F.sum}, compact_every=4)
    sizes = []
    for batch in range(14):
        store.apply(rows(spark, ("a", 1), (f"k{batch % 2}", 1)).coalesce(1), batch)
        sizes.append(len(files(tmp_path)))
    assert content(store) == [("a", 14), ("k0", 7), ("k1", 7)]
    assert max(sizes) < 30  # two bases and eight changes at most


def test_a_write_that_was_not_named_is_not_read_and_goes(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), SCHEMA, ["key"])
    store.apply(rows(spark, ("a", 1)), 0)
    store._write(rows(spark, ("lost", 1)), "changes")  # a writer that died before its manifest
    assert content(store) == [("a", 1)]
    store.compact()
    store.compact()
    assert len(list((tmp_path / "changes").iterdir())) <= 1 and content(store) == [("a", 1)]
    with pytest.raises(FileExistsError):
        store._commit(store.manifest())


def test_compaction_forgets_what_is_not_kept(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path), SCHEMA, ["key"], keep=F.col("value") > 1)
    store.apply(rows(spark, ("a", 1), ("b", 2)), 0)
    store.compact()
    assert content(store) == [("b", 2)]


# ---------------------------------------------------------------- stored baselines


def run(task, number, state, log, day=10):
    start = datetime(2024, 1, day) + timedelta(minutes=number)
    return ("d", task, f"r{number:03d}", 1, state, start, start + timedelta(minutes=1), log)


def some_log(number):
    return "\n".join(f"[{number}] INFO - {('load', 'read', 'x7', 'write')[(number * at) % 4]} table t{at % 5} rows {'abc'[number % 3]}" for at in range(1, 12))


@pytest.fixture(scope="module")
def table(spark):
    made = [run(f"t{number % 3}", number, "failed" if number % 4 == 3 else "success", some_log(number)) for number in range(60)]
    return spark.createDataFrame(made, RUN)


def templates_of(frame):
    return sorted(map(tuple, frame.select("task_id", "cluster_no", "template", "size").collect()))


def test_two_growth_steps_equal_one(spark, tmp_path, table):
    lines = logs.log_entries(table.filter("state = 'success'"))
    whole = baseline.tree_baseline(lines, AS_OF)
    store = stored_baselines.tree_store(spark, str(tmp_path), compact_every=2)
    assert stored_baselines.grow(store, lines.filter("run_id < 'r020'"), AS_OF, batch=0)
    assert not stored_baselines.grow(store, lines.filter("run_id < 'r020'"), AS_OF, batch=0)
    stored_baselines.grow(store, lines.filter("run_id between 'r020' and 'r030' and task_id = 't1'"), AS_OF)  # one task alone
    stored_baselines.grow(store, lines.filter("run_id >= 'r020' and not (run_id <= 'r030' and task_id = 't1')"), AS_OF)
    assert templates_of(stored_baselines.templates(store)) == templates_of(whole)
    counts = {row.task_id: (row.line_count, row.evicted_count) for row in store.read().collect()}
    assert counts == {row.task_id: (row["count"], 0) for row in lines.groupBy("task_id").count().collect()}


def test_a_bounded_tree_says_what_it_dropped(spark, table):
    lines = logs.log_entries(table)
    states = baseline.grow_states(lines, settings=baseline.TreeSettings(max_clusters=2, similarity=0.9)).collect()
    assert all(row.template_count == 2 and row.evicted_count > 0 for row in states)


def test_growth_takes_a_task_a_stretch_at_a_time(spark, monkeypatch):
    """No part of the tree sees more than a few batches of lines, and the answer is that of line by line, from new and from saved trees."""
    words = ("load", "read", "open it", "write", "close all of it")
    entries = [(dag, task, f"r{run}", attempt, at, f"{words[(run * at + attempt) % 5]} table {'abcd'[(run + at) % 4]} rows {'xyz'[at % 3]}")
               for dag, task, runs in (("d", "t0", 40), ("d", "t1", 3), (None, "t0", 12), ("d", None, 2)) for run in range(runs)
               for attempt in (1, 2) for at in range(1, 8 + run % 4)]
    entries += entries[:50]  # lines that come twice
    random.Random(3).shuffle(entries)
    lines = spark.createDataFrame(entries, "dag_id string, task_id string, run_id string, try_number int, line_number int, message string").repartition(3)
    whole = template_tree.TemplateTree.feed

    def feed(tree, texts):
        texts = list(texts)
        assert sum(len(places) for _, places in texts) <= 40, "more of a task than a stretch"
        return whole(tree, texts)

    expected = {}
    args = baseline.TreeSettings().args()
    for dag, task, _, _, _, message in sorted(entries, key=lambda one: (one[0] or "", one[1] or "", *one[2:])):
        expected.setdefault((dag, task), template_tree.TemplateTree(*args)).add(message.split(" "))
    monkeypatch.setattr(template_tree.TemplateTree, "feed", feed)
    monkeypatch.setattr(baseline, "FED_ROWS", 20, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        once = {(row.dag_id, row.task_id): row for row in baseline.grow_states(lines).collect()}
        first = baseline.grow_states(lines.filter("run_id < 'r2'")).localCheckpoint()
        later = {(row.dag_id, row.task_id): row for row in baseline.grow_states(lines.filter("run_id >= 'r2'"), first).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for grown in (once, later):
        assert set(grown) == set(expected)
        for key, tree in expected.items():
            row, made = grown[key], template_tree.TemplateTree.load(grown[key].state).templates()
            assert made == tree.templates() and row.template_count == len(made)
            assert row.line_count == sum(size for _, _, size in made) and row.evicted_count == 0
    assert later["d", None] == first.filter("task_id is null").first()  # without later lines a tree stays as it is


def test_refresh_rebuilds_stale_tasks_alone(spark, tmp_path, table):
    store = stored_baselines.tree_store(spark, str(tmp_path))
    lines = logs.log_entries(table.filter("state = 'success'"))
    stored_baselines.grow(store, lines.filter("task_id = 't0'"), AS_OF - timedelta(days=90))
    stored_baselines.grow(store, lines.filter("task_id = 't1' and run_id < 'r010'"), AS_OF - timedelta(days=1))
    before = {row.task_id: row for row in store.read().collect()}
    stale = stored_baselines.refresh(store, table, table, AS_OF, refresh_days=7)
    assert {row.task_id for row in stale.collect()} == {"t0", "t2"}
    after = {row.task_id: row for row in store.read().collect()}
    assert after["t1"] == before["t1"] and after["t0"].updated_at == after["t2"].updated_at == AS_OF
    assert after["t0"].line_count == 33 and before["t0"].line_count > 33  # three runs of eleven lines
    stored_baselines.refresh(store, table, table, AS_OF + timedelta(days=30), refresh_days=7, keep_old=True)
    assert {row.task_id: row.line_count for row in store.read().collect()}["t0"] == 66


# ---------------------------------------------------------------- streams


def test_tree_stream_in_polls_equals_the_batch_form(spark, tmp_path, table):
    learnt = baseline.tree_baseline(baseline.baseline_lines(table.filter("task_id <> 't2'"), table), AS_OF)
    failed = table.filter("state = 'failed'")
    expected = {tuple(row) for row in novelty.novel_lines(novelty.tree_novelty(failed, learnt)).select(*TRY_KEY, "line_number").collect()}
    lines = logs.log_entries(failed).select(*TRY_KEY, "line_number", "message")
    seeds = tree_state.seed_states(learnt)
    store = tree_state.fork_store(spark, str(tmp_path / "forks"), compact_every=2)
    for poll in ("line_number <= 4", "line_number between 5 and 7", "line_number > 7 and run_id < 'r030'", "line_number > 7 and run_id >= 'r030'"):
        lines.filter(poll).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
        tree_state.new_templates(arriving, lambda: seeds, str(tmp_path / "out"), str(tmp_path / "state"), store).awaitTermination()
    found = [tuple(row) for row in spark.read.parquet(str(tmp_path / "out")).select(*TRY_KEY, "line_number").collect()]
    assert set(found) == expected and len(found) == len(expected)
    assert {row.task_id for row in store.read().collect()} == {"t0", "t1"}  # without a baseline nothing is kept


def test_updated_windows_leave_out_late_rows(spark, tmp_path):
    schema = "dag_id string, start_date timestamp_ntz"
    store = stream.window_store(spark, str(tmp_path / "counts"), compact_every=2)

    def poll(*days):
        spark.createDataFrame([("d", datetime(2024, 1, day, 12)) for day in days], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = stream.file_stream(spark, str(tmp_path / "in"), StructType.fromDDL(schema))
        counts = stream.windowed_counts(stream.with_event_time(source), stream.tumbling())
        query = stream.to_store(counts, store, str(tmp_path / "state"))
        query.awaitTermination()
        return query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"]

    poll(1, 2, 2)
    poll(2, 3)
    kept = poll(9)
    poll(1, 9)  # the first day is behind the watermark
    assert {row.window_start.day: row.failures for row in store.read().collect()} == {1: 1, 2: 3, 3: 1, 9: 2}
    assert kept == 1


def test_each_batch_meets_the_newest_baseline(spark, tmp_path, table):
    shapes = baseline.shape_baseline(logs.log_entries(table.filter("state = 'success'")), AS_OF)
    current = [shapes.limit(0)]
    failed = table.filter("state = 'failed'")
    sizes = []
    for part in ("run_id < 'r030'", "run_id >= 'r030'"):
        failed.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = stream.file_stream(spark, str(tmp_path / "in"), table.schema)
        monitoring.analyse_batches(source, lambda: current[0], str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        current[0] = shapes
    found = spark.read.parquet(str(tmp_path / "out"))
    sizes = {row.early: (row.all_new, row.n) for row in found.groupBy((F.col("run_id") < "r030").alias("early")).agg(
        F.bool_and(F.col("n_anomalous") == F.col("n_lines")).alias("all_new"), F.count("*").alias("n")).collect()}
    assert sizes == {True: (True, 7), False: (False, 8)}


def test_tries_of_a_batch_share_python_batches(spark, table):
    learnt = baseline.tree_baseline(baseline.baseline_lines(table.filter("task_id <> 't2'"), table), AS_OF)
    failed = table.filter("state = 'failed'")
    lines = logs.log_entries(failed).select(*TRY_KEY, "line_number", "message")
    seeds = tree_state.seed_states(learnt)
    nobody = spark.createDataFrame([], tree_state.FORKS)
    grown = tree_state.grow_tries(lines, seeds.unionAll(seeds), nobody)
    plan = grown._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "CoGroup" not in plan  # a Python group a try costs more than the try
    rows = grown.collect()
    expected = {tuple(row) for row in novelty.novel_lines(novelty.tree_novelty(failed, learnt)).select(*TRY_KEY, "line_number").collect()}
    assert {(*row[:4], number) for row in rows for number in row.created} == expected and len(rows) == failed.count()
    assert {row.task_id for row in rows if row.state is None} == {"t2"}

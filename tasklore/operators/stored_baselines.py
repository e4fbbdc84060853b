"""Baselines that live on: saved trees of all tasks in a keyed store, grown by new runs or rebuilt when they are stale."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tasklore.functions import fixed_values as fv
from tasklore.operators import baseline as baselines
from tasklore.operators.sizing import join_measured, measured
from tasklore.schemas import TASK_KEY
from tasklore.sources.keyed_store import KeyedStore

STORED = baselines.STATE_SCHEMA + ", updated_at timestamp_ntz"


def tree_store(spark: SparkSession, path: str, compact_every: int = 16) -> KeyedStore:
    """One saved tree a task; the newest state of a task counts."""
    return KeyedStore(spark, path, StructType.fromDDL(STORED), TASK_KEY, compact_every=compact_every)


def grow(store: KeyedStore, lines: DataFrame, as_of: datetime, settings: baselines.TreeSettings = baselines.TreeSettings(),
         batch: int | None = None) -> bool:
    """Add the lines of new runs to the stored trees of their tasks; other tasks are neither read into Python nor written.

    Growing in steps equals growing once if later steps hold later runs. A ``batch`` that is in the store already changes nothing.
    """
    number = store.next_batch() if batch is None else batch
    if store.manifest().holds(number):
        return False
    before = join_measured(store.read(), lines.select(*TASK_KEY).distinct(), TASK_KEY, "grown-tasks")
    grown = baselines.grow_states(lines, before, settings)
    return store.apply(grown.withColumn("updated_at", F.lit(as_of).cast("timestamp_ntz")), number)


def refresh(store: KeyedStore, tasks: DataFrame, logs: DataFrame, as_of: datetime, refresh_days: int = fv.BASELINE_REFRESH_DAYS,
            settings: baselines.TreeSettings = baselines.TreeSettings(), runs: int = fv.BASELINE_RUNS, keep_old: bool = False) -> DataFrame:
    """Rebuild the trees of stale tasks alone, from their latest successes; returns the stale keys.

    With ``keep_old`` a stale tree is grown by those lines instead of replaced. A task without a successful run keeps what it has.
    """
    state = store.read().select(*TASK_KEY, F.col("updated_at").alias("created_at"), F.col("updated_at").alias("last_updated"))
    stale, small = measured(baselines.baseline_state(tasks, state, as_of, refresh_days).filter("is_stale").select(*TASK_KEY), "stale")
    lines = baselines.baseline_lines(tasks.join(F.broadcast(stale) if small else stale, TASK_KEY, "left_semi"), logs, runs)
    if keep_old:
        grow(store, lines, as_of, settings)
    else:
        rebuilt = baselines.grow_states(lines, None, settings)
        store.apply(rebuilt.withColumn("updated_at", F.lit(as_of).cast("timestamp_ntz")), store.next_batch())
    return stale


def templates(store: KeyedStore) -> DataFrame:
    """The baseline table of the stored trees."""
    return baselines.stored_table(store.read())

"""Baselines: the templates of recent successful runs, per (dag, task)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import templates
from tasklore.operators import logs as log_ops
from tasklore.operators import template_tree
from tasklore.operators.sizing import join_measured, measured
from tasklore.operators.tasks import recent_successes
from tasklore.schemas import TASK_KEY, TRY_KEY

# The tree travels inside the task closure, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(template_tree)

BASELINE_SCHEMA = "dag_id string, task_id string, cluster_no int, template string, size bigint"


@dataclass(frozen=True)
class TreeSettings:
    depth: int = fv.TREE_DEPTH
    similarity: float = fv.TREE_SIMILARITY
    max_children: int = fv.TREE_MAX_CHILDREN
    max_clusters: int | None = None  # fv.TREE_MAX_CLUSTERS is the usual bound; what it drops is counted in ``evicted_count``

    def args(self) -> tuple[int, float, int, int | None]:
        return self.depth, self.similarity, self.max_children, self.max_clusters


def baseline_lines(tasks: DataFrame, logs: DataFrame, runs: int = fv.BASELINE_RUNS,
                   max_lines: int | None = None) -> DataFrame:
    """Structured lines of the runs that make up each baseline.

    The run keys come first and are few (a handful per task); they are measured and broadcast to the
    scan of the log table, so texts of other runs are dropped where they are read.
    """
    keys = recent_successes(tasks, runs).select(*TRY_KEY, "start_date")
    texts = join_measured(logs.select(*TRY_KEY, "log_content"), keys, TRY_KEY, "baseline-runs")
    return log_ops.log_entries(texts, max_lines)


def shape_baseline(lines: DataFrame, as_of: datetime | Column) -> DataFrame:
    """Baseline table with order-free templates: one grouped count, no Python."""
    counted = log_ops.with_template(lines).groupBy(*TASK_KEY, "template").agg(F.count("*").alias("size"))
    numbered = counted.withColumn(
        "cluster_no", F.row_number().over(Window.partitionBy(*TASK_KEY).orderBy("template")) - 1)
    return _identify(numbered, as_of)


STATE_SCHEMA = "dag_id string, task_id string, state binary, line_count bigint, template_count int, evicted_count bigint"
SAVED = "struct<state: binary, line_count: bigint, template_count: int, evicted_count: bigint>"
FED_ROWS, FED_BYTES = 50_000, 8 * 1024 * 1024  # about so much of a task's lines goes to its tree at once


def distinct_lines(lines: DataFrame) -> DataFrame:
    """Normalised texts of each try with the numbers of their lines; merged where the lines are read."""
    fed = lines.select(*TRY_KEY, "line_number", templates.normalise(F.col("message")).alias("normal"))
    return fed.groupBy(*TRY_KEY, "normal").agg(F.array_sort(F.collect_list("line_number")).alias("numbers"))


def grow_states(lines: DataFrame, states: DataFrame | None = None, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """Saved trees, one a task, after its lines in (run, try, line) order; given states are grown further, others are new.

    Growing in two steps equals growing once over all lines if the second step's runs come after the first's. The lines of a task
    come sorted by Spark, after its saved tree, and pass through Python a stretch at a time, so neither side holds a task's lines,
    however many it has. ``evicted_count`` says how many templates a bounded tree has dropped.
    """
    args = settings.args()
    rows = lines.select(*TRY_KEY, "line_number", templates.normalise(F.col("message")).alias("normal"))
    if states is None:
        rows = rows.withColumn("saved", F.lit(None).cast(SAVED))
    else:
        known = states.select(*TASK_KEY, F.struct("state", "line_count", "template_count", "evicted_count").cast(SAVED).alias("saved"))
        rows = rows.unionByName(known, allowMissingColumns=True)
    last = [F.col(name).asc_nulls_last() for name in ("run_id", "try_number")]
    ordered = rows.repartition(*TASK_KEY).sortWithinPartitions(*TASK_KEY, F.col("saved").isNull(), *last, "line_number", "normal")

    def feed(tree: template_tree.TemplateTree, waiting: list[pa.Array]) -> None:
        coded = pc.fill_null(pa.concat_arrays(waiting), "").dictionary_encode()
        codes = coded.indices.to_numpy()
        places = np.split(np.argsort(codes, kind="stable"), np.cumsum(np.bincount(codes))[:-1])
        tree.feed([(text, numbers.tolist()) for text, numbers in zip(coded.dictionary.to_pylist(), places, strict=True)])
        waiting.clear()

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept, tree, count = None, [], None, 0
        waiting: list[pa.Array] = []
        done: list[tuple] = []

        def end() -> None:
            """The row of a task whose lines are over; one without lines keeps what it has."""
            if waiting:
                feed(tree, waiting)
            if tree is None:
                done.extend((*key, *one.values()) for one in kept)
            else:
                done.append((*key, tree.save(), count, len(tree.templates()), tree.evicted))

        def written() -> pa.RecordBatch:
            columns = [pa.array(values, kind) for values, kind in zip(zip(*done, strict=True), kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int32(), pa.int64()]
        names = [*TASK_KEY, "state", "line_count", "template_count", "evicted_count"]
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            ends = {stop for name in TASK_KEY for stop in pc.run_end_encode(columns[name]).run_ends.to_pylist()}
            for start, stop in pairwise([0, *sorted(ends)]):
                now = tuple(columns[name][start].as_py() for name in TASK_KEY)
                if now != key:
                    if key is not None:
                        end()
                    if sum(len(row[2]) for row in done) >= FED_BYTES or len(done) >= FED_ROWS:
                        yield written()
                    key, kept, tree, count = now, [], None, 0
                saved = columns["saved"].slice(start, stop - start).drop_null()
                kept += saved.to_pylist()
                fed = columns["normal"].slice(start + len(saved), stop - start - len(saved))
                if not len(fed):
                    continue
                if tree is None and kept:
                    tree, count = template_tree.TemplateTree.load(kept[0]["state"]), kept[0]["line_count"]
                elif tree is None:
                    tree = template_tree.TemplateTree(*args)
                waiting.append(fed)
                count += len(fed)
                if sum(map(len, waiting)) >= FED_ROWS or sum(part.nbytes for part in waiting) >= FED_BYTES:
                    feed(tree, waiting)
        if key is not None:
            end()
        if done:
            yield written()

    return ordered.mapInArrow(grow, STATE_SCHEMA)


def state_templates(states: DataFrame) -> DataFrame:
    """Templates of saved trees in creation order: ``dag_id, task_id, cluster_no, template, size``."""
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(dag, task, number, template, size) for dag, task, state in zip(batch["dag_id"], batch["task_id"], batch["state"], strict=True)
                    for number, (_, template, size) in enumerate(template_tree.TemplateTree.load(state).templates())]
            yield pd.DataFrame(rows, columns=["dag_id", "task_id", "cluster_no", "template", "size"])

    return states.select(*TASK_KEY, "state").mapInPandas(listed, BASELINE_SCHEMA)


def stored_table(states: DataFrame) -> DataFrame:
    """Saved trees as a baseline table; their own time of update is the age mark."""
    updated = states.select(*TASK_KEY, "updated_at")
    return _identify(state_templates(states).join(updated, TASK_KEY), F.col("updated_at"))


def tree_baseline(lines: DataFrame, as_of: datetime | Column, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """Baseline table mined with the template tree, lines fed in (run, try, line) order."""
    return _identify(state_templates(grow_states(lines, settings=settings)), as_of)


def _identify(numbered: DataFrame, as_of: datetime | Column) -> DataFrame:
    moment = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("timestamp_ntz")
    return numbered.select(
        F.format_string("%s.%s_cluster_%d", "dag_id", "task_id", "cluster_no").alias("cluster_id"),
        *TASK_KEY, F.col("cluster_no").cast("int").alias("cluster_no"), "template",
        F.col("size").cast("bigint").alias("size"),
        moment.alias("created_at"), moment.alias("last_updated"),
    )


def known_templates(baseline: DataFrame) -> DataFrame:
    """One row per (dag, task): its templates in cluster order and its age mark. Bounded by the lines of its runs."""
    packed = baseline.groupBy(*TASK_KEY).agg(
        F.sort_array(F.collect_list(F.struct("cluster_no", "template"))).alias("packed"),
        F.max("last_updated").alias("baseline_updated"))
    return packed.select(*TASK_KEY, F.transform("packed", lambda item: item["template"]).alias("known"), "baseline_updated")


def age_days(as_of: datetime, updated: Column) -> Column:
    """Whole days between the last update and the given moment."""
    micros = F.timestamp_diff("MICROSECOND", updated, F.lit(as_of).cast("timestamp_ntz"))
    return F.floor(micros / 86_400_000_000).cast("int")


def baseline_state(tasks: DataFrame, baseline: DataFrame, as_of: datetime,
                   refresh_days: int = fv.BASELINE_REFRESH_DAYS) -> DataFrame:
    """Size, age in whole days and staleness for every (dag, task); tasks without a baseline count as stale."""
    built = baseline.groupBy(*TASK_KEY).agg(
        F.count("*").alias("cluster_count"), F.min("created_at").alias("created_at"),
        F.max("last_updated").alias("last_updated"))
    age = F.coalesce(age_days(as_of, F.col("last_updated")), F.lit(0))
    stale = F.col("last_updated").isNull() | (F.col("age_days") >= refresh_days) | (F.col("cluster_count") < 1)
    return (
        tasks.select(*TASK_KEY).distinct().join(built, TASK_KEY, "left")
        .withColumns({"cluster_count": F.coalesce("cluster_count", F.lit(0)), "age_days": age})
        .withColumn("is_stale", stale)
    )


def refresh(tasks: DataFrame, stored: DataFrame, rebuilt: DataFrame, as_of: datetime,
            refresh_days: int = fv.BASELINE_REFRESH_DAYS) -> DataFrame:
    """Stale baselines are replaced by their rebuilt form; one that nothing can replace stays in use, as do fresh ones."""
    stale = baseline_state(tasks, stored, as_of, refresh_days).filter("is_stale").select(*TASK_KEY)
    new = rebuilt.join(stale, TASK_KEY, "left_semi")
    return stored.join(new.select(*TASK_KEY).distinct(), TASK_KEY, "left_anti").unionByName(new)


def refresh_stale(tasks: DataFrame, stored: DataFrame, rebuild: Callable[[DataFrame], DataFrame], as_of: datetime,
                  refresh_days: int = fv.BASELINE_REFRESH_DAYS) -> DataFrame:
    """As ``refresh``, but only the runs of stale tasks are handed to ``rebuild``: logs of fresh tasks are not read."""
    stale, small = measured(baseline_state(tasks, stored, as_of, refresh_days).filter("is_stale").select(*TASK_KEY), "stale")
    new = rebuild(tasks.join(F.broadcast(stale) if small else stale, TASK_KEY, "left_semi"))
    return stored.join(new.select(*TASK_KEY).distinct(), TASK_KEY, "left_anti").unionByName(new)


def listing(tasks: DataFrame, baseline: DataFrame, as_of: datetime, runs: int = fv.BASELINE_RUNS,
            refresh_days: int = fv.BASELINE_REFRESH_DAYS) -> DataFrame:
    """One row per baseline with the number of successful runs behind it."""
    behind = recent_successes(tasks, runs).groupBy(*TASK_KEY).agg(F.count("*").alias("successful_runs"))
    state = baseline_state(baseline, baseline, as_of, refresh_days)
    return (
        state.join(behind, TASK_KEY, "left")
        .select(*TASK_KEY, "cluster_count", "created_at", "last_updated",
                F.coalesce("successful_runs", F.lit(0)).alias("successful_runs"), "is_stale")
    )


def statistics(baseline: DataFrame, as_of: datetime, refresh_days: int = fv.BASELINE_REFRESH_DAYS) -> DataFrame:
    """Number of baselines, their ages, and how many are fresh (below half the refresh time), moderate, stale."""
    age = F.col("age_days")
    fresh, stale = age < refresh_days / 2, age >= refresh_days
    return baseline_state(baseline, baseline, as_of, refresh_days).agg(
        F.count("*").alias("total_baselines"),
        F.coalesce(F.avg(age), F.lit(0.0)).alias("average_age_days"),
        F.coalesce(F.max(age), F.lit(0)).alias("oldest_baseline_days"),
        F.coalesce(F.min(age), F.lit(0)).alias("newest_baseline_days"),
        F.count_if(fresh).alias("fresh"),
        F.count_if(~fresh & ~stale).alias("moderate"),
        F.count_if(stale).alias("stale"),
    )


def retain(baseline: DataFrame, as_of: datetime, retention_days: int = fv.BASELINE_RETENTION_DAYS) -> DataFrame:
    """Baselines not older than the retention time."""
    return baseline.filter(age_days(as_of, F.col("last_updated")) <= retention_days)


def clear(baseline: DataFrame, dag_id: str, task_id: str) -> DataFrame:
    """All baselines but that of one task."""
    return baseline.filter(~((F.col("dag_id") == dag_id) & (F.col("task_id") == task_id)))

"""The template tree over a stream of lines: lines of a failed try that open a new template, however many batches they come in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tasklore.functions import templates
from tasklore.operators import template_tree
from tasklore.operators.baseline import TreeSettings, distinct_lines, known_templates
from tasklore.operators.novelty import SEEDED_TREES
from tasklore.operators.sizing import join_measured, measured
from tasklore.schemas import TASK_KEY, TRY_KEY
from tasklore.session import scratch_path
from tasklore.sources.keyed_store import KeyedStore

FORKS = "dag_id string, task_id string, run_id string, try_number int, state binary, updated_at timestamp"
GROWN = "dag_id string, task_id string, run_id string, try_number int, state binary, created array<bigint>"
EXPIRY = "7 days"


def seed_states(baseline: DataFrame, settings: TreeSettings = TreeSettings()) -> DataFrame:
    """One saved tree a task, fed with the templates of its baseline in their order: ``dag_id, task_id, seed``."""
    args = settings.args()

    def seeded(batch: pd.Series) -> pd.Series:
        out = []
        for texts in batch:
            tree = template_tree.TemplateTree(*args)
            for text in texts:
                tree.add(text.split(" ") if text else [])
            out.append(tree.save())
        return pd.Series(out)

    save = F.pandas_udf(seeded, "binary")
    return known_templates(baseline).select(*TASK_KEY, save(F.transform("known", templates.normalise)).alias("seed"))


def fork_store(spark: SparkSession, path: str, expiry: str = EXPIRY, compact_every: int = 16) -> KeyedStore:
    """The grown tree of every try under way. A compaction forgets tries without a line for the given time."""
    fresh = F.col("updated_at") > F.current_timestamp() - F.expr(f"INTERVAL {expiry}")
    return KeyedStore(spark, path, StructType.fromDDL(FORKS), TRY_KEY, compact_every=compact_every, keep=fresh)


def grow_tries(lines: DataFrame, seeds: DataFrame, forks: DataFrame) -> DataFrame:
    """The trees of the tries in a batch after its lines, and the lines that opened a template.

    A try goes on from its fork, or from its task's seed if it is new; without either every line counts as new and nothing is kept.
    Only keys meet the stored forks. A try is one row with its different texts in the batch, so many tries share an Arrow batch and
    a hot task is spread by its tries; new tries of a task fork its seed, which is loaded once a task of Spark (or few times, if seeds are many).
    """
    merged = distinct_lines(lines.withColumn("try_number", F.col("try_number").cast("int")))
    fed = merged.groupBy(*TRY_KEY).agg(F.collect_list("normal").alias("normals"), F.collect_list("numbers").alias("numbers"))
    keys = measured(merged.select(*TRY_KEY).distinct(), "batch-tries")[0]
    own = join_measured(forks.select(*TRY_KEY, "state"), keys, TRY_KEY, "batch-forks")
    first = seeds.groupBy(*TASK_KEY).agg(F.max("seed").alias("seed"))
    ready = fed.join(own, TRY_KEY, "left").join(first, TASK_KEY, "left").select(
        *TRY_KEY, "state", F.when(F.col("state").isNull(), F.col("seed")).alias("seed"), "normals", "numbers")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeded: dict[bytes, template_tree.TemplateTree] = {}
        for batch in batches:
            names = batch.schema.names
            states, created = [], []
            for state, seed, normals, numbers in zip(*[batch.column(names.index(name)).to_pylist() for name in ("state", "seed", "normals", "numbers")], strict=True):
                if state is None and seed is None:
                    states.append(None)
                    created.append(sorted(number for places in numbers for number in places))
                    continue
                if state is None:
                    if seed not in seeded:
                        if len(seeded) >= SEEDED_TREES:
                            seeded.pop(next(iter(seeded)))
                        seeded[seed] = template_tree.TemplateTree.load(seed)
                    tree = seeded[seed].fork()
                else:
                    tree = template_tree.TemplateTree.load(state)
                created.append(tree.feed(list(zip(normals, numbers, strict=True))))
                states.append(tree.save())
            mine = [pa.array(states, pa.binary()), pa.array(created, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(name)) for name in TRY_KEY), *mine], names=[*TRY_KEY, "state", "created"])

    return ready.mapInArrow(grow, GROWN)


def new_templates(lines: DataFrame, seeds: Callable[[], DataFrame], path: str, checkpoint: str, store: KeyedStore,
                  trigger: dict | None = None) -> StreamingQuery:
    """Write the lines whose template neither the baseline nor an earlier line of the try has, below ``path/batch_id=``.

    ``lines`` is a stream with the try key, ``line_number`` and ``message``; the lines of a try may come in several batches, in order.
    ``seeds`` is asked for each batch, so a refreshed baseline holds for tries that start after it. A batch that is delivered
    again finds its forks as they were before it, or all of it done.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        if store.manifest().holds(batch_id):
            return
        scratch = scratch_path(batch.sparkSession, "grown")
        grow_tries(batch, seeds(), store.read()).write.parquet(scratch)
        grown = batch.sparkSession.read.schema(StructType.fromDDL(GROWN)).parquet(scratch)
        grown.select(*TRY_KEY, F.explode("created").alias("line_number")).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        store.apply(grown.filter("state is not null").select(*TRY_KEY, "state", F.current_timestamp().alias("updated_at")), batch_id)

    writer = lines.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(**(trigger or {"availableNow": True})).start()

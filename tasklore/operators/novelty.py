"""Lines of a failed try whose template the baseline does not know.

Every try stays one row. The only data that meets is a try and the template array of its task, one
bounded array per task. While all arrays together are small they are broadcast and no try moves. Beyond
that the join is shuffled, and a task with very many failed tries is split: its tries are spread over
salts and its template array is repeated once per salt.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import templates
from tasklore.operators import logs as log_ops
from tasklore.operators import template_tree
from tasklore.operators.baseline import TreeSettings, known_templates
from tasklore.operators.sizing import MAX_BROADCAST_BYTES, measured
from tasklore.schemas import TASK_KEY

cloudpickle.register_pickle_by_value(template_tree)

SALTS = 16
SEEDED_TREES = 64  # trees kept per Python task; tries of one task fork the seeded tree instead of feeding it again


def attach_known(tries: DataFrame, baseline: DataFrame, salts: int = SALTS,
                 max_bytes: int = MAX_BROADCAST_BYTES, seeds: bool = False) -> DataFrame:
    """Add ``known``, the templates of the task, and ``baseline_updated``; both null when it has no baseline.

    ``seeds`` adds ``seed_text``, the normalised templates as one JSON text: made once a task, not once a try.
    """
    known = known_templates(baseline)
    if seeds:
        known = known.withColumn("seed_text", F.to_json(F.transform("known", templates.normalise)))
    known, small = measured(known, "known-templates", max_bytes)
    if small:
        return tries.join(F.broadcast(known), TASK_KEY, "left")
    salt = F.pmod(F.xxhash64("run_id", "try_number"), F.lit(salts)).cast("int")
    repeated = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return tries.withColumn("salt", salt).join(repeated, [*TASK_KEY, "salt"], "left").drop("salt")


def shape_novelty(tries: DataFrame, baseline: DataFrame, max_lines: int | None = None) -> DataFrame:
    """Add ``lines`` and ``anomalous`` using order-free templates.

    Anomalous is the first line of each template outside the baseline; without a baseline every line is.
    """
    attached = log_ops.with_lines(attach_known(tries, baseline), max_lines, with_template=True)
    shaped = log_ops.pin(attached, shapes=F.transform("lines", lambda item: item["template"]))
    new = F.array_except("shapes", F.coalesce(F.col("known"), F.array().cast("array<string>")))
    first = F.transform(new, lambda shape: F.element_at(F.col("lines"), F.array_position(F.col("shapes"), shape).cast("int")))
    return log_ops.pin(shaped, anomalous=F.when(F.col("known").isNull(), F.col("lines")).otherwise(first)).drop("shapes")


def tree_novelty(tries: DataFrame, baseline: DataFrame, max_lines: int | None = None,
                 settings: TreeSettings = TreeSettings()) -> DataFrame:
    """Add ``lines`` and ``anomalous`` using the template tree seeded with the baseline.

    The Python side sees one try per record with the seeds of its task and its lines; equal lines are looked at together.
    Spark bounds an Arrow batch by ``spark.sql.execution.arrow.maxBytesPerBatch``.
    """
    attached = log_ops.with_lines(attach_known(tries, baseline, seeds=True), max_lines)
    fed = attached.withColumn("line_text", F.transform("lines", lambda item: templates.normalise(item["message"])))
    created = fed.withColumn("created", _created_positions(settings)(F.col("seed_text"), F.col("line_text")))
    first = F.transform("created", lambda position: F.element_at(F.col("lines"), position))
    anomalous = F.when(F.col("seed_text").isNull(), F.col("lines")).otherwise(first)
    return log_ops.pin(created, anomalous=anomalous).drop("seed_text", "line_text", "created")


def _created_positions(settings: TreeSettings):
    """Arrow UDF: (seeds as JSON, line texts) to the 1-based positions of lines that open a new template."""
    args = settings.args()

    def created(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        def split(text: str) -> list[str]:
            return text.split(" ") if text else []

        def seeded(seed: str) -> template_tree.TemplateTree:
            tree = template_tree.TemplateTree(*args)
            for text in json.loads(seed):
                tree.add(split(text))
            return tree

        kept: dict[str, template_tree.TemplateTree] = {}
        for seeds, lines in batches:
            out: list[list[int]] = []
            for seed, line in zip(seeds.to_pylist(), lines.to_pylist(), strict=True):
                if seed is None:
                    out.append([])
                    continue
                if seed not in kept:
                    if len(kept) >= SEEDED_TREES:
                        kept.pop(next(iter(kept)))
                    kept[seed] = seeded(seed)
                places: dict[str, list[int]] = {}
                for number, text in enumerate(line, start=1):
                    places.setdefault(text, []).append(number)
                out.append(kept[seed].fork().feed(places.items()))
            yield pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(created, "array<int>")


def novelty_score(lines: Column, anomalous: Column) -> Column:
    """Share of anomalous lines, 0 for an empty log."""
    return F.coalesce(F.try_divide(F.size(anomalous), F.size(lines)), F.lit(0.0))


def novel_lines(novelty: DataFrame) -> DataFrame:
    """Anomalous lines as rows."""
    return novelty.select("dag_id", "task_id", "run_id", "try_number", F.inline("anomalous")).drop("template")

"""Training rows: built from analysed tries and from human corrections, split and formatted."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import scoring, text
from tasklore.operators.ranking import with_position
from tasklore.schemas import TRY_KEY


def json_text(fields: Column) -> Column:
    """JSON object that keeps fields without a value."""
    return F.to_json(fields, {"ignoreNullFields": "false"})


def live_examples(analysed: DataFrame) -> DataFrame:
    """Failed tries with surviving lines: joined lines, error line and ids."""
    return analysed.filter(F.col("n_candidates") > 0).select(
        scoring.joined_messages(F.col("candidates")).alias("candidates"),
        text.short_text(F.col("error_line")).alias("error"), *TRY_KEY)


def feedback_examples(candidates: DataFrame) -> DataFrame:
    """Reviewed candidates with a human category as corrected analyses."""
    sure = F.when(F.col("status") == "approved", 1.0).otherwise(0.9)
    reviewer = F.col("reviewed_by") if "reviewed_by" in candidates.columns else F.lit(None).cast("string")
    corrected = F.struct(
        F.col("error_message").alias("error_message"), F.col("human_category").alias("category"),
        text.first_present(F.col("human_severity"), F.col("llm_severity")).alias("severity"), sure.alias("confidence"),
        text.first_present(F.col("human_feedback"), F.lit("Human correction")).alias("reasoning"),
        F.array("error_message").alias("error_lines"))
    kept = F.col("status").isin("approved", "rejected", "modified") & text.present(F.col("human_category"))
    return candidates.filter(kept).select(
        "id", F.col("raw_logs").alias("log_context"), F.col("error_message").alias("original_error"),
        corrected.alias("corrected_analysis"), F.coalesce(reviewer, F.lit("web_annotator")).alias("user_id"),
        sure.alias("confidence_rating"), "dag_id", "task_id", "run_id", F.col("status").alias("feedback_type"))


def _metadata(created_at: datetime, **values: Column) -> Column:
    values = {**values, "created_at": F.lit(created_at.isoformat())}
    return F.create_map(*[part for name, value in values.items() for part in (F.lit(name), value.cast("string"))])


def instruction_set(live: DataFrame, corrected: DataFrame, created_at: datetime, instruction: str = fv.INSTRUCTION) -> DataFrame:
    """Both sources as (example_id, instruction, input, output, metadata) rows."""
    def rows(source: DataFrame, key: Column, log: str, output: Column, metadata: Column) -> DataFrame:
        return source.select(
            key.alias("example_id"), F.lit(instruction).alias("instruction"),
            F.concat(F.lit("Log Context:\n"), F.coalesce(log, F.lit(""))).alias("input"),
            json_text(output).alias("output"), metadata.alias("metadata"))

    from_tries = rows(live, F.concat_ws("/", F.lit("try"), *TRY_KEY), "candidates",
                      scoring.structured_output(F.col("error")),
                      _metadata(created_at, source=F.lit("raw_training_data")))
    from_people = rows(corrected, F.concat_ws("/", F.lit("candidate"), "id"), "log_context", F.col("corrected_analysis"),
                       _metadata(created_at, source=F.lit("user_feedback"), user_id=F.col("user_id"),
                                 feedback_confidence=F.col("confidence_rating")))
    return from_tries.unionByName(from_people)


def feedback_export(rows: DataFrame, instruction: str = fv.FEEDBACK_INSTRUCTION) -> DataFrame:
    """Rated feedback rows as instruction, input, JSON output and metadata."""
    reasoning = F.col("corrected_reasoning") if "corrected_reasoning" in rows.columns else F.lit(None).cast("string")
    output = F.struct(
        F.col("corrected_error").alias("error_message"), F.col("corrected_category").alias("category"),
        F.col("corrected_severity").alias("severity"), F.lit(0.9).alias("confidence"), reasoning.alias("reasoning"))
    metadata = F.struct("dag_id", "task_id", "user_rating", F.lit("user_feedback").alias("source"))
    return rows.select("id", F.lit(instruction).alias("instruction"), F.col("log_context").alias("input"),
                       json_text(output).alias("output"), metadata.alias("metadata"))


def extraction_set(reviewed: DataFrame, head: str = fv.EXTRACTION_HEAD, tail: str = fv.EXTRACTION_TAIL) -> DataFrame:
    """Reviewed rows: the log inside the instruction, the trimmed human text as output."""
    return reviewed.select("id", F.concat(F.lit(head), "raw_logs", F.lit(tail)).alias("instruction"),
                           F.lit("").alias("input"), text.strip(F.col("human_feedback")).alias("output"))


def split_ordered(examples: DataFrame, *order: str, train_ratio: float = 0.8) -> DataFrame:
    """Add ``split``: the first part in unique ``order`` is train, the rest validation.

    Only the order columns are ranked; the texts are compared with the key of the first validation row and do not move.
    """
    placed = with_position(examples.select(*order), *order)
    bound = placed.filter(F.col("position") == F.floor(F.col("total") * F.lit(train_ratio)))
    first_held = bound.select(F.struct(*order).alias("key")).scalar()
    in_train = F.coalesce(F.struct(*order) < first_held, F.lit(True))  # no such row: all are train
    return examples.withColumn("split", F.when(in_train, "train").otherwise("validation"))


def split_random(examples: DataFrame, *key: str, test_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` by a seeded hash of the key: repeatable, and no shuffle."""
    bucket = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(10_000))
    return examples.withColumn("split", F.when(bucket < int((1 - test_ratio) * 10_000), "train").otherwise("validation"))


def dataset_info(split: DataFrame, minimum: int = fv.MIN_TRAINING_EXAMPLES) -> DataFrame:
    return split.agg(
        F.count_if(F.col("split") == "train").alias("train_size"),
        F.count_if(F.col("split") == "validation").alias("validation_size"),
        F.count("*").alias("total_size"), (F.count("*") < minimum).alias("below_minimum"))


def ordered_info(examples: DataFrame, train_ratio: float = 0.8, minimum: int = fv.MIN_TRAINING_EXAMPLES) -> DataFrame:
    """What ``dataset_info`` says of an ordered split, from the row count alone."""
    total = F.col("total_size")
    train = F.floor(total * F.lit(train_ratio))
    return examples.agg(F.count("*").alias("total_size")).select(
        train.alias("train_size"), (total - train).alias("validation_size"), total, (total < minimum).alias("below_minimum"))


def chat_format(examples: DataFrame, system: str = fv.CHAT_SYSTEM) -> DataFrame:
    """System, user and assistant messages per example."""
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return examples.withColumn("messages", F.array(
        message("system", F.lit(system)),
        message("user", F.concat("instruction", F.lit("\n\n"), "input")),
        message("assistant", F.col("output"))))


def completion_format(examples: DataFrame) -> DataFrame:
    return examples.withColumns({
        "prompt": F.concat(F.lit("Human: "), "instruction", F.lit("\n\n"), "input", F.lit("\n\nAssistant:")),
        "completion": F.concat(F.lit(" "), "output")})


def instruct_text(examples: DataFrame) -> DataFrame:
    return examples.withColumn("text", F.concat(
        F.lit("### Instruction:\n"), "instruction", F.lit("\n\n### Input:\n"), "input",
        F.lit("\n\n### Response:\n"), "output"))

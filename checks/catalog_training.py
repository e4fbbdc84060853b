"""Checked queries over training rows, evaluation, files and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import sql
from checks.catalog_analysis import ANALYZE_SQL, TRY, analysed, failed_texts, learnt, learnt_tree
from checks.registry import check
from checks.views import AS_OF, Views
from tasklore.functions import fixed_values as fv
from tasklore.functions import similarity, templates
from tasklore.operators import candidates, datasets, evaluation, feedback, logs, stored_baselines
from tasklore.plans import monitoring
from tasklore.schemas import TASK_KEY, TRY_KEY
from tasklore.session import scratch_path
from tasklore.sources import readers, writers
from tasklore.streaming import failures as stream
from tasklore.streaming import tree_state

# ---------------------------------------------------------------- training rows

_SHORT = "CASE WHEN length(error_line) > 160 THEN substr(error_line, 1, 157) || '...' ELSE error_line END"


@check("d01_live_examples", f"SELECT {TRY}, candidate_text AS candidates, {_SHORT} AS error FROM fail_errors")
def d01(v: Views) -> DataFrame:
    return datasets.live_examples(analysed(v))


_CORRECTED = """(SELECT *, CASE WHEN status = 'approved' THEN 1.0::DOUBLE ELSE 0.9::DOUBLE END AS sure FROM error_candidates
  WHERE status IN ('approved', 'rejected', 'modified') AND coalesce(human_category, '') <> '') c"""


@check("d02_feedback_examples", f"""
SELECT id, raw_logs AS log_context, error_message AS original_error, human_category AS category, coalesce(human_severity, llm_severity) AS severity,
  sure AS confidence, coalesce(human_feedback, 'Human correction') AS reasoning, 'web_annotator' AS user_id, sure AS confidence_rating,
  dag_id, task_id, run_id, status AS feedback_type FROM {_CORRECTED}""")
def d02(v: Views) -> DataFrame:
    return datasets.feedback_examples(v.error_candidates).select(
        "id", "log_context", "original_error", "corrected_analysis.category", "corrected_analysis.severity",
        "corrected_analysis.confidence", "corrected_analysis.reasoning", "user_id", "confidence_rating",
        "dag_id", "task_id", "run_id", "feedback_type")


@check("d03_instruction_set", f"""
SELECT 'try/' || dag_id || '/' || task_id || '/' || run_id || '/' || try_number AS example_id, {sql.lit(fv.INSTRUCTION)} AS instruction,
  'Log Context:' || chr(10) || candidate_text AS input, {_SHORT} AS error_message, {sql.category(_SHORT)} AS category,
  'raw_training_data' AS source, NULL AS feedback_confidence FROM fail_errors
UNION ALL SELECT 'candidate/' || id, {sql.lit(fv.INSTRUCTION)}, 'Log Context:' || chr(10) || raw_logs, error_message, human_category,
  'user_feedback', CASE WHEN status = 'approved' THEN '1.0' ELSE '0.9' END FROM {_CORRECTED}""")
def d03(v: Views) -> DataFrame:
    rows = datasets.instruction_set(datasets.live_examples(analysed(v)), datasets.feedback_examples(v.error_candidates), AS_OF)
    return rows.select("example_id", "instruction", "input", F.get_json_object("output", "$.error_message").alias("error_message"),
                       F.get_json_object("output", "$.category").alias("category"), F.col("metadata.source").alias("source"),
                       F.try_element_at("metadata", F.lit("feedback_confidence")).alias("feedback_confidence"))


@check("d04_feedback_export", f"""
SELECT f.id, {sql.lit(fv.FEEDBACK_INSTRUCTION)} AS instruction, e.log_context AS input, f.corrected_error AS error_message, f.corrected_category AS category,
  f.corrected_severity AS severity, '0.9' AS confidence, e.dag_id, e.task_id, f.user_rating, 'user_feedback' AS source
FROM user_feedback f JOIN error_logs e ON f.error_log_id = e.id WHERE f.user_rating >= 3""")
def d04(v: Views) -> DataFrame:
    rows = datasets.feedback_export(feedback.training_rows(v.error_logs, v.ai_analysis, v.user_feedback))
    fields = [F.get_json_object("output", f"$.{name}").alias(name) for name in ("error_message", "category", "severity", "confidence")]
    return rows.select("id", "instruction", "input", *fields, "metadata.*")


_NOTES = f"human_feedback IS NOT NULL AND human_feedback <> 'null' AND {sql.strip('human_feedback')} <> '' AND status IN ('approved', 'modify', 'modified')"
_EXTRACTION = f"""(SELECT id, {sql.lit(fv.EXTRACTION_HEAD)} || raw_logs || {sql.lit(fv.EXTRACTION_TAIL)} AS instruction, '' AS input,
  {sql.strip('human_feedback')} AS output FROM error_candidates WHERE {_NOTES}) x"""


def extraction(v: Views) -> DataFrame:
    return datasets.extraction_set(candidates.reviewed(v.error_candidates))


@check("d05_extraction_set", f"SELECT id, instruction, input, output FROM {_EXTRACTION}")
def d05(v: Views) -> DataFrame:
    return extraction(v)


@check("d06_split_ordered", f"""
SELECT id, output, CASE WHEN row_number() OVER (ORDER BY id) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM {_EXTRACTION}""")
def d06(v: Views) -> DataFrame:
    return datasets.split_ordered(extraction(v), "id").select("id", "output", "split")


@check("d07_split_random")
def d07(v: Views) -> DataFrame:
    return datasets.split_random(extraction(v), "id").select("id", "split")


@check("d08_dataset_info", f"""
SELECT CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS train_size, n - CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS validation_size, n AS total_size, n < 50 AS below_minimum
FROM (SELECT count(*) AS n FROM {_EXTRACTION}) c""")
def d08(v: Views) -> DataFrame:
    return datasets.ordered_info(extraction(v))


@check("d09_chat_format", f"""
SELECT id, 'system:' || {sql.lit(fv.CHAT_SYSTEM)} || '|user:' || instruction || chr(10) || chr(10) || input || '|assistant:' || output AS messages
FROM (SELECT id, instruction, input, output FROM {_EXTRACTION}
  UNION ALL SELECT 'conv_' || u.conv_id || '_' || u.turn, u.text, '', a.text FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant') y""")
def d09(v: Views) -> DataFrame:
    talk = v.table("conversations")
    asked = talk.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction"))
    told = talk.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    turns = asked.join(told, ["conv_id", "turn"]).select(
        F.concat(F.lit("conv_"), "conv_id", F.lit("_"), "turn").alias("id"), "instruction", F.lit("").alias("input"), "output")
    chat = datasets.chat_format(extraction(v).unionByName(turns))
    return chat.select("id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages"))


@check("d10_completion_format", f"""
SELECT id, 'Human: ' || instruction || chr(10) || chr(10) || input || chr(10) || chr(10) || 'Assistant:' AS prompt, ' ' || output AS completion FROM {_EXTRACTION}""")
def d10(v: Views) -> DataFrame:
    return datasets.completion_format(extraction(v)).select("id", "prompt", "completion")


@check("d11_instruct_text", f"""
SELECT id, '### Instruction:' || chr(10) || instruction || chr(10) || chr(10) || '### Input:' || chr(10) || input || chr(10) || chr(10) || '### Response:' || chr(10) || output AS text
FROM {_EXTRACTION}""")
def d11(v: Views) -> DataFrame:
    return datasets.instruct_text(extraction(v)).select("id", "text")


# ---------------------------------------------------------------- evaluation

_CLEANED = f"(SELECT *, {sql.clean('generated')} AS g, {sql.clean('expected')} AS e FROM eval_pairs) p"
_TERMS = """list_distinct(list_concat(list_concat(list_concat(list_concat(regexp_extract_all(e, '(?i)TPT[0-9]+'), regexp_extract_all(e, '(?i)Error [0-9]+')),
  regexp_extract_all(e, '(?i)timeout|connection|failed|missing|not found|deadlock')), regexp_extract_all(e, '(?i)[A-Z_]+\\[[^\\]]+\\]')),
  regexp_extract_all(e, '"([^"]*)"', 1)))"""
_SCORED = f"""(SELECT *, lower(g) = lower(e) AS exact_match,
  coalesce(len(list_filter(terms, lambda t: contains(lower(g), lower(t)))) / nullif(len(terms), 0)::DOUBLE >= 0.7, false) AS correct_extraction,
  CASE WHEN len(tg) + len(te) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(tg, te)) / (len(tg) + len(te) - len(list_intersect(tg, te)))::DOUBLE END AS similarity_score
FROM (SELECT *, {_TERMS} AS terms, list_distinct(list_filter(string_split(lower(g), ' '), lambda t: t <> '')) AS tg,
    list_distinct(list_filter(string_split(lower(e), ' '), lambda t: t <> '')) AS te FROM {_CLEANED}) q) s"""


def scored(v: Views) -> DataFrame:
    return evaluation.score(v.eval_pairs)


@check("e01_clean", f"SELECT example_id, g AS generated_clean, e AS expected_clean FROM {_CLEANED}")
def e01(v: Views) -> DataFrame:
    return scored(v).select("example_id", "generated_clean", "expected_clean")


@check("e02_exact_match", f"SELECT example_id, exact_match FROM {_SCORED}")
def e02(v: Views) -> DataFrame:
    return scored(v).select("example_id", "exact_match")


@check("e03_error_terms", f"SELECT example_id, array_to_string(list_sort(terms), '|') AS terms FROM {_SCORED}")
def e03(v: Views) -> DataFrame:
    terms = similarity.error_terms(F.col("expected_clean"))
    return scored(v).select("example_id", F.array_join(F.array_sort(terms), "|").alias("terms"))


@check("e04_term_recall", f"SELECT example_id, correct_extraction FROM {_SCORED}")
def e04(v: Views) -> DataFrame:
    return scored(v).select("example_id", "correct_extraction")


@check("e05_jaccard", f"SELECT example_id, similarity_score FROM {_SCORED}")
def e05(v: Views) -> DataFrame:
    return scored(v).select("example_id", "similarity_score")


_RATES = """count(*) AS num_examples, count_if(correct_extraction) / count(*)::DOUBLE AS accuracy, count_if(exact_match) / count(*)::DOUBLE AS exact_match_rate,
  count_if(correct_extraction) AS correct_extractions, count_if(exact_match) AS exact_matches"""


@check("e06_eval_summary", f"SELECT {_RATES} FROM {_SCORED}")
def e06(v: Views) -> DataFrame:
    return evaluation.summary(scored(v))


def _edge(part: str, order: str) -> str:
    cut = "CASE WHEN length({x}) > 100 THEN substr({x}, 1, 100) || '...' ELSE {x} END"
    return f"""(SELECT '{part}' AS part, example_id, similarity_score, exact_match, correct_extraction, {cut.format(x='generated')} AS generated_preview,
  {cut.format(x='expected')} AS expected_preview FROM {_SCORED} ORDER BY {order} LIMIT 5)"""


@check("e07_best_worst", _edge("best", "similarity_score DESC, example_id") + " UNION ALL " + _edge("worst", "similarity_score, example_id DESC"))
def e07(v: Views) -> DataFrame:
    return evaluation.best_and_worst(scored(v), "example_id")


@check("e08_perplexity", """
SELECT floor(avg(loss) * 1e6 + 0.5) / 1e6 AS average_loss, floor(exp(avg(loss)) * 1e6 + 0.5) / 1e6 AS perplexity, count(*) AS num_examples FROM eval_pairs""")
def e08(v: Views) -> DataFrame:
    result = evaluation.perplexity(v.eval_pairs)
    return result.withColumns({n: F.floor(F.col(n) * 1e6 + 0.5) / 1e6 for n in ("average_loss", "perplexity")})


@check("e09_category_eval", f"SELECT grp, {_RATES}, floor(avg(similarity_score) * 1e6 + 0.5) / 1e6 AS avg_similarity FROM {_SCORED} GROUP BY grp")
def e09(v: Views) -> DataFrame:
    return evaluation.by_category(scored(v), "grp").withColumn("avg_similarity", F.floor(F.col("avg_similarity") * 1e6 + 0.5) / 1e6)


# ---------------------------------------------------------------- files written to the shared folder and read back


@check("k01_store_error_logs", "SELECT id, ts, dag_id, task_id, run_id, error_message, log_context, resolved, dt AS date FROM error_logs")
def k01(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "error_logs")
    writers.store_error_logs(v.error_logs.drop("dt"), path)
    return v.spark.read.parquet(path)


@check("k02_store_analysis", """
SELECT id, error_log_id, analysis_ts, extracted_error, predicted_category, predicted_severity, confidence_score, model_version, '{"model_version":"' || model_version || '"}' AS analysis_metadata FROM ai_analysis""")
def k02(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "ai_analysis")
    writers.store_analyses(v.ai_analysis, path)
    return v.spark.read.parquet(path)


_FEEDBACK_ROWS = """(SELECT f.id, f.reviewer, e.dag_id, e.task_id, f.feedback_ts, f.corrected_category, f.user_rating, e.error_message,
  e.dag_id || '_' || e.task_id || '_' || CAST(floor(epoch_us(f.feedback_ts) / 1000000.0) AS BIGINT) AS feedback_id
FROM user_feedback f JOIN error_logs e ON e.id = f.error_log_id) r"""


def feedback_rows(v: Views) -> DataFrame:
    errors = v.error_logs.select(F.col("id").alias("error_log_id"), "dag_id", "task_id", "error_message")
    joined = v.user_feedback.join(errors, "error_log_id").select(
        "id", "reviewer", "dag_id", "task_id", "feedback_ts", "corrected_category", "user_rating", "error_message")
    return writers.feedback_id(joined)


@check("k03_store_feedback", f"SELECT id, feedback_id, reviewer, dag_id, task_id, feedback_ts, corrected_category, user_rating, error_message FROM {_FEEDBACK_ROWS}")
def k03(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "user_feedback")
    writers.store_feedback(feedback_rows(v), path)
    return v.spark.read.parquet(path)


@check("k08_training_jsonl", f"SELECT instruction, input, output, id AS source_id FROM {_EXTRACTION}")
def k08(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "examples")
    writers.save_examples(extraction(v).select("instruction", "input", "output", F.create_map(F.lit("id"), "id").alias("metadata")), path)
    return readers.training_examples(v.spark, path).select("instruction", "input", "output", F.col("metadata")["id"].alias("source_id"))


def packed_runs(v: Views) -> tuple[str, DataFrame]:
    """Logs of all runs, many a file, and where each one is."""
    path = scratch_path(v.spark, "logs")
    return path, writers.pack_logs(v.task_runs.select("run_id", "log_content"), path, "run_id", pack_bytes=1_000_000)


@check("s05_raw_logs", "SELECT run_id, log_content FROM task_runs")
def s05(v: Views) -> DataFrame:
    path, manifest = packed_runs(v)
    return readers.packed_logs(v.spark, path, manifest, "run_id")


@check("s06_log_manifest", """
SELECT run_id, dag_id, task_id, date_trunc('second', start_date) AS start_date, date_trunc('second', end_date) AS end_date, log_content FROM task_runs""")
def s06(v: Views) -> DataFrame:
    (path, packs), manifest = packed_runs(v), scratch_path(v.spark, "manifest")
    times = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start_date", "end_date")]
    packs.join(v.task_runs.select("run_id", "dag_id", "task_id", *times), "run_id").select(
        "pack", "log_offset", "log_length", "start_date", "end_date", "dag_id", "task_id", "run_id").write.csv(manifest, header=True)
    return readers.packed_manifest(v.spark, manifest, path)


@check("s07_jsonl_candidates", """
SELECT sha256(c || '|' || e) AS id, coalesce(nullif(regexp_extract(c, 'DAG_ID[=:]\\s*[''"]?([^''",$\\s]+)', 1), ''), 'unknown') AS dag_id, 'unknown' AS task_id, e AS error_message, c AS raw_logs, 'pending' AS status
FROM (SELECT CASE k % 3 WHEN 0 THEN 'DAG_ID="' || dag_id || '"' || chr(10) || log_content ELSE log_content END AS c, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE err_text END AS e
  FROM task_runs WHERE state = 'failed' AND k % 7 <> 0) x WHERE coalesce(e, '') <> ''""")
def s07(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "candidate_lines")
    log = F.when(F.col("k") % 3 == 0, F.concat(F.lit('DAG_ID="'), "dag_id", F.lit('"\n'), "log_content")).otherwise(F.col("log_content"))
    error = F.when(F.col("k") % 5 == 0, "").when(F.col("k") % 5 == 1, None).otherwise(F.col("err_text"))
    line = F.to_json(F.struct(log.alias("candidates"), error.alias("error")))
    # Some lines are broken on purpose; the reader must skip them.
    v.task_runs.filter("state = 'failed'").select(
        F.when(F.col("k") % 7 == 0, F.left(line, F.lit(40))).otherwise(line).alias("value")).write.text(path)
    return readers.candidate_lines(v.spark, path).select("id", "dag_id", "task_id", "error_message", "raw_logs", "status")


@check("s08_feedback_jsonl", f"SELECT feedback_id, dag_id, task_id, reviewer AS user_id, user_rating, corrected_category AS category, error_message FROM {_FEEDBACK_ROWS}")
def s08(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "feedback_records")
    nothing = F.lit(None).cast("string")

    def analysis(category):
        return F.struct(F.col("error_message"), F.lit(0.9).alias("confidence"), category.alias("category"), nothing.alias("severity"), nothing.alias("reasoning"))

    writers.store_feedback_records(feedback_rows(v).select(
        "dag_id", "task_id", analysis(nothing).alias("original_analysis"), analysis(F.col("corrected_category")).alias("corrected_analysis"),
        "user_rating", F.col("reviewer").alias("user_id"), "feedback_id"), path)
    return readers.feedback_records(v.spark, path).select("feedback_id", "dag_id", "task_id", "user_id", "user_rating",
                                                          "corrected_analysis.category", "corrected_analysis.error_message")


@check("s09_reviewed_json", "SELECT id, raw_logs, human_feedback, status FROM error_candidates")
def s09(v: Views) -> DataFrame:
    path = scratch_path(v.spark, "reviewed")
    writers.write_json_arrays(v.error_candidates.select("id", "raw_logs", "human_feedback", "status"), path, "id", rows_per_document=500)
    return readers.reviewed_rows(v.spark, path)


# ---------------------------------------------------------------- streams, each run to the end of the available data


def streamed(v: Views) -> Views:
    """The same views over the events table read as a stream."""
    schema = v.table("events").schema
    return Views(v.spark, v.folder, stream.file_stream(v.spark, v.folder, schema, "events.parquet"))


def finish(query) -> None:
    query.awaitTermination()


def drain(v: Views, rows: DataFrame, name: str, mode: str = "append") -> str:
    path = scratch_path(v.spark, name)
    finish(stream.to_batches(rows, f"{path}/out", f"{path}/state", mode))
    return f"{path}/out"


def stream_tries(v: Views) -> DataFrame:
    return stream.with_event_time(stream.failed_tries(streamed(v).task_tries))


@check("t01_failure_stream", "SELECT dag_id, task_id, run_id, try_number, start_date FROM task_tries WHERE state = 'failed' AND try_number > 0")
def t01(v: Views) -> DataFrame:
    path = drain(v, stream_tries(v).select(*TRY_KEY, "start_date"), "failures")
    return v.spark.read.parquet(path).drop("batch_id")


@check("t02_late_dedup", "SELECT dag_id, task_id, run_id, try_number FROM task_tries WHERE state = 'failed' AND try_number > 0")
def t02(v: Views) -> DataFrame:
    # Overlapping polls: every try arrives twice.
    doubled = stream_tries(v).withColumn("poll", F.explode(F.array(F.lit(1), F.lit(2))))
    path = drain(v, stream.once_per_try(doubled).select(*TRY_KEY), "deduplicated")
    return v.spark.read.parquet(path).drop("batch_id")


_FAILS = "(SELECT dag_id, start_date AS ts FROM task_tries WHERE state = 'failed' AND try_number > 0) f"


@check("t03_windowed_counts", f"""
SELECT 'day' AS kind, dag_id, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, count(*) AS failures FROM {_FAILS} GROUP BY ALL
UNION ALL SELECT 'hour', dag_id, w, w + INTERVAL 1 HOUR, count(*) FROM (SELECT dag_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '2024-01-01') - to_minutes(15 * i) AS w
  FROM {_FAILS}, (SELECT unnest([0, 1, 2, 3]) AS i) o) h GROUP BY ALL
UNION ALL SELECT 'session', dag_id, min(ts), max(ts) + INTERVAL 30 MINUTE, count(*) FROM (SELECT *, sum(fresh) OVER (PARTITION BY dag_id ORDER BY ts, fresh DESC ROWS UNBOUNDED PRECEDING) AS part
  FROM (SELECT *, CASE WHEN ts <= lag(ts) OVER (PARTITION BY dag_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {_FAILS}) m) n GROUP BY dag_id, part""")
def t03(v: Views) -> DataFrame:
    parts = []
    for kind, window in (("day", stream.tumbling()), ("hour", stream.sliding()), ("session", stream.session())):
        path = scratch_path(v.spark, f"windows-{kind}")
        store = stream.window_store(v.spark, f"{path}/counts")
        tries = stream.failed_tries(streamed(v).task_tries).select("dag_id", "start_date")
        if kind == "session":  # sessions leave the state when they are over; a row far ahead ends the last ones
            v.spark.sql("SELECT CAST(NULL AS string) AS dag_id, TIMESTAMP_NTZ '2999-01-01' AS start_date").write.parquet(f"{path}/end")
            tries = tries.union(v.spark.readStream.schema(tries.schema).parquet(f"{path}/end"))
        counts = stream.windowed_counts(stream.with_event_time(tries), window)
        finish(stream.to_store(counts, store, f"{path}/state", "append" if kind == "session" else "update"))
        parts.append(store.read().select(
            F.lit(kind).alias("kind"), "dag_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"),
            F.col("window_end").cast("timestamp_ntz").alias("window_end"), "failures"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@check("t04_running_stats", """
SELECT date_trunc('day', start_date) AS day, count(*) AS processed, floor(sum(value) * 1e6 + 0.5) / 1e6 AS total_processing_time,
  floor(avg(value) * 1e6 + 0.5) / 1e6 AS average_processing_time FROM task_runs WHERE state = 'failed' GROUP BY 1""")
def t04(v: Views) -> DataFrame:
    results = stream.with_event_time(streamed(v).task_runs.filter("state = 'failed'"))
    path = scratch_path(v.spark, "stats")
    store = stream.stats_store(v.spark, f"{path}/days")
    finish(stream.to_store(stream.daily_stats(results, "value"), store, f"{path}/state"))
    return store.read().select(F.col("day").cast("timestamp_ntz").alias("day"), "processed",
                         *[(F.floor(F.col(n) * 1e6 + 0.5) / 1e6).alias(n) for n in ("total_processing_time", "average_processing_time")])


@check("t05_results_sink", """
SELECT 'results' AS part, run_id, severity, NULL AS recipient FROM (SELECT *, CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END AS severity FROM task_runs WHERE state = 'failed') r
UNION ALL SELECT 'alerts', run_id, 'high', CASE WHEN dag_id = 'dag_1' THEN '+1' ELSE '+9' END FROM task_runs WHERE state = 'failed' AND k % 2 = 0
UNION ALL SELECT 'events', run_id, CASE WHEN k % 2 = 0 THEN 'high' ELSE 'low' END, NULL FROM task_runs WHERE state = 'failed'""")
def t05(v: Views) -> DataFrame:
    failed = streamed(v).task_runs.filter("state = 'failed'")
    results = failed.select(
        F.col("run_id").alias("id"), "dag_id", "task_id", "run_id", F.lit(True).alias("success"), F.col("value").alias("processing_time"),
        F.col("err_text").alias("error_message"), F.lit("unknown").alias("category"),
        F.when(F.col("k") % 2 == 0, "high").otherwise("low").alias("severity"), F.col("start_date").alias("ts"))
    path = scratch_path(v.spark, "results")
    finish(stream.to_results(results, f"{path}/out", f"{path}/state", {"dag_1": ["+1"]}, ["+9"]))
    read = {name: v.spark.read.parquet(f"{path}/out/{name}") for name in ("results", "alerts", "events")}
    nobody = F.lit(None).cast("string").alias("recipient")
    return (
        read["results"].select(F.lit("results").alias("part"), "run_id", "severity", nobody)
        .unionByName(read["alerts"].select(F.lit("alerts").alias("part"), "run_id", "severity", "recipient"))
        .unionByName(read["events"].select(F.lit("events").alias("part"), "run_id", F.get_json_object("data", "$.severity").alias("severity"), nobody)))


@check("t05_stream_analysis", ANALYZE_SQL)
def t05_analysis(v: Views) -> DataFrame:
    tries = streamed(v).task_tries.join(v.task_fail.select("run_id"), "run_id", "left_semi")
    path = scratch_path(v.spark, "stream-analysis")
    finish(monitoring.analyse_batches(tries, lambda: learnt(v), f"{path}/out", f"{path}/state"))
    return v.spark.read.parquet(f"{path}/out").drop("batch_id")


@check("t06_baseline_static_join", """
SELECT l.dag_id, l.task_id, l.run_id, l.try_number, l.line_number, l.template FROM (SELECT * FROM shaped_lines) l JOIN task_fail f ON f.run_id = l.run_id
WHERE NOT EXISTS (SELECT 1 FROM base_templates b WHERE b.dag_id = l.dag_id AND b.task_id = l.task_id AND b.template = l.template)""")
def t06(v: Views) -> DataFrame:
    lines = logs.with_template(logs.log_entries(streamed(v).task_runs.filter("state = 'failed'")))
    path = drain(v, stream.unknown_lines(lines.select(*TRY_KEY, "line_number", "template"), learnt(v)), "unknown")
    return v.spark.read.parquet(path).drop("batch_id")


@check("t07_baseline_stream", """
SELECT s.dag_id, s.task_id, s.template, count(*) AS size, max(s.ts) AS last_updated FROM shaped_lines s JOIN task_runs r ON r.run_id = s.run_id
WHERE r.state = 'success' GROUP BY ALL""")
def t07(v: Views) -> DataFrame:
    lines = logs.log_entries(streamed(v).task_runs.filter("state = 'success'"))
    shaped = lines.select(*TASK_KEY, templates.shape_template(F.col("message")).alias("template"), "ts")
    path = scratch_path(v.spark, "baseline")
    store = stream.baseline_store(v.spark, f"{path}/out")
    finish(stream.grow_baseline(shaped, store, f"{path}/state"))
    return store.read()


@check("t06_tree_stream")
def t06_tree(v: Views) -> DataFrame:
    """Lines of failed tries in three polls, each going on from the trees the last one left."""
    path = scratch_path(v.spark, "tree-stream")
    logs.log_entries(failed_texts(v)).select(*TRY_KEY, "line_number", "message").write.parquet(f"{path}/lines")
    tree_state.seed_states(learnt_tree(v)).write.parquet(f"{path}/seeds")
    lines, store = v.spark.read.parquet(f"{path}/lines"), tree_state.fork_store(v.spark, f"{path}/forks", compact_every=2)
    for poll in ("line_number <= 3", "line_number in (4, 5)", "line_number > 5"):
        lines.filter(poll).write.mode("append").parquet(f"{path}/in")
        arriving = v.spark.readStream.schema(lines.schema).parquet(f"{path}/in")
        finish(tree_state.new_templates(arriving, lambda: v.spark.read.parquet(f"{path}/seeds"), f"{path}/out", f"{path}/state", store))
    return v.spark.read.parquet(f"{path}/out").drop("batch_id")


@check("t07_tree_growth")
def t07_tree(v: Views) -> DataFrame:
    """Saved trees of all successful runs, grown in two steps."""
    store = stored_baselines.tree_store(v.spark, scratch_path(v.spark, "trees"))
    lines = logs.log_entries(v.heavy.task_runs.filter("state = 'success'"))
    for step in ("run_id < 'run_5'", "run_id >= 'run_5'"):
        stored_baselines.grow(store, lines.filter(step), AS_OF)
    return stored_baselines.templates(store).select(*TASK_KEY, "cluster_no", "template", "size")

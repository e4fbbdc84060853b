"""Operators on small tables, against brute force or hand-made results."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tasklore import schemas
from tasklore.functions import fixed_values as fv
from tasklore.functions import rules, templates
from tasklore.operators import alerts, baseline, candidates, datasets, evaluation, extension, logs, novelty, pattern_index, ranking, reports, tasks
from tasklore.operators.sizing import join_measured, measured
from tasklore.operators.template_tree import CREATED, TemplateTree
from tasklore.plans import failure_analysis as plan

AS_OF = datetime(2024, 1, 31)
RUN = "dag_id string, task_id string, run_id string, try_number int, state string, start_date timestamp_ntz, end_date timestamp_ntz, log_content string"


def run(dag, task, number, state, log, try_number=1, day=10):
    start = datetime(2024, 1, day) + timedelta(minutes=number)
    return (dag, task, f"r{number:03d}", try_number, state, start, start + timedelta(minutes=1), log)


# ---------------------------------------------------------------- template tree


def random_lines(seed, n=400):
    rng = random.Random(seed)
    words = ["load", "table", "read", "rows", "failed", "host", "a1", "b2", "<:NUM:>", "done"]
    return [[rng.choice(words) for _ in range(rng.randint(0, 6))] for _ in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_tree_properties(seed):
    fed = random_lines(seed)
    tree = TemplateTree()
    homes = [tree.add(line)[1] for line in fed]
    found = {key: (template.split(" ") if template else [], size) for key, template, size in tree.templates()}
    assert sum(size for _, size in found.values()) == len(fed)
    for line, home in zip(fed, homes):
        template = found[home][0]
        assert len(template) == len(line)
        assert all(t in ("<*>", token) for t, token in zip(template, line))
        fixed = sum(t != "<*>" for t in template)
        assert not line or fixed / len(line) >= 0.4


def test_fed_lines_are_never_new_again():
    """Holds while no first token is routed through the wildcard child. With it, a line absorbed there can
    come back as new once its first token has got a child of its own."""
    fed = [line for line in random_lines(6) if not line or not any(ch.isdigit() for ch in line[0])]
    tree = TemplateTree()
    for line in fed:
        tree.add(line)
    assert all(tree.add(line)[0] != CREATED for line in fed)


def test_tree_limits():
    tree = TemplateTree(max_children=3, max_clusters=2)
    for word in ("a", "b", "c", "d"):
        tree.add([word, "x", "y"])
    assert len(tree.templates()) == 2 and tree.evicted == 1
    assert tree.add(["a", "x", "y"])[0] == CREATED  # evicted as least recently used
    deep = TemplateTree(depth=5)
    deep.add(["a", "b", "c", "d", "e"])
    assert deep.add(["a", "z", "c", "d", "e"])[0] == CREATED  # second level keys differ


def test_tree_copy_is_independent():
    tree = TemplateTree()
    for line in random_lines(8):
        tree.add(line)
    before = tree.templates()
    twin = tree.fork()
    outcomes = [twin.add(line)[0] for line in random_lines(9)]
    assert tree.templates() == before and twin.templates() != before
    assert outcomes == [tree.add(line)[0] for line in random_lines(9)]


def by_line(tree, lines):
    return [number for number, line in enumerate(lines) if tree.add(line)[0] == CREATED]


def places(lines, start=0):
    found = {}
    for number, line in enumerate(lines, start):
        found.setdefault(" ".join(line), []).append(number)
    return list(found.items())


@pytest.mark.parametrize("settings", [{}, {"depth": 5}, {"depth": 6, "max_children": 3}, {"max_children": 4}, {"similarity": 0.7}, {"max_clusters": 5}])
def test_texts_with_positions_equal_line_by_line(settings):
    for seed in range(40):
        rng = random.Random(seed)
        words = ["load", "table", "read", "x1", "x2", "y3", "done", "<*>", "q"][: rng.randint(3, 9)]
        fed = [[rng.choice(words) for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 300))]
        slow, quick = TemplateTree(**settings), TemplateTree(**settings)
        for part in (fed, fed[::-1]):  # a second feeding goes on from the first
            assert quick.feed(places(part)) == by_line(slow, part)
            assert quick.templates() == slow.templates() and quick.evicted == slow.evicted


def test_saved_and_forked_trees_go_on_like_the_first():
    for settings in ({}, {"max_clusters": 6}, {"depth": 5, "max_children": 3}):
        tree = TemplateTree(**settings)
        by_line(tree, random_lines(1))
        loaded, fork = TemplateTree.load(tree.save()), tree.fork()
        outcomes = [[one.add(line) for line in random_lines(2)] for one in (tree, loaded, fork)]
        assert outcomes[0] == outcomes[1] == outcomes[2]
        assert tree.save() == loaded.save() == fork.save()


def test_a_weight_counts_like_repeats():
    one, many = TemplateTree(), TemplateTree()
    one.add(["a", "b"], 3)
    assert [many.add(["a", "b"])[0] for _ in range(3)] == [CREATED, "none", "none"] and one.templates() == many.templates()


def test_tree_merges_above_the_threshold():
    tree = TemplateTree()
    assert tree.add("[t] INFO - x y".split())[0] == CREATED
    assert tree.add("[t] ERROR - x z".split()) == ("changed", 0)
    assert tree.templates() == [(0, "[t] <*> - x <*>", 2)]


# ---------------------------------------------------------------- baselines and novelty

LOGS = [
    run("d", "t", 1, "success", "[a] start 1\n\n[a] read 5 rows\n[a] end"),
    run("d", "t", 2, "success", "[a] start 2\n[a] read 7 rows\n[a] end"),
    run("d", "t", 3, "success", "[a] start 3\n[a] old only"),
    run("d", "t", 4, "success", "[a] second try ignored", try_number=2),
    run("d", "t", 5, "success", "[a] start 9\n[a] end"),
    run("d", "t", 6, "failed", "[a] start 4\n[a] boom in x\n[a] boom in x\n[a] read 9 rows\n  "),
    run("d", "t", 7, "failed", "[a] end"),
    run("d", "new", 8, "failed", "[a] boom in y\n[a] boom in y"),
    run("d", "t", 9, "failed", "\n \n"),
]


@pytest.fixture(scope="module")
def runs(spark):
    return spark.createDataFrame(LOGS, RUN)


def test_recent_successes_take_the_newest_first_tries(runs):
    picked = {(r["run_id"], r["recency"]) for r in tasks.recent_successes(runs, 3).collect()}
    assert picked == {("r005", 1), ("r003", 2), ("r002", 3)}


def test_recent_successes_are_cut_before_the_shuffle(runs):
    plan_text = tasks.recent_successes(runs, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan_text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("exact", [False, True])
def test_analysis_of_each_try(runs, exact):
    quiet = rules.RuleSet((rules.Rule("substring", "nothing at all"),))
    rows = {r["run_id"]: r for r in plan.analyze_tries(runs, runs, runs, AS_OF, 60 * 24 * 60, quiet, exact=exact).collect()}
    assert set(rows) == {"r006", "r007", "r008", "r009"}
    novel = rows["r006"]
    assert [line["message"] for line in novel["candidates"]] == ["[a] boom in x"]  # a repeat is not novel
    assert (novel["n_lines"], novel["novelty_score"], novel["is_known_pattern"]) == (4, 0.25, False)
    assert rows["r007"]["is_known_pattern"] and rows["r007"]["analysis"]["error_message"] == "No error patterns identified"
    assert [line["line_number"] for line in rows["r008"]["candidates"]] == [1, 2]  # no baseline: every line
    empty = rows["r009"]
    assert (empty["n_lines"], empty["novelty_score"], empty["is_known_pattern"]) == (0, 0.0, False)


def test_only_failed_tasks_are_learnt(runs, monkeypatch):
    healthy = runs.filter("state = 'success'").withColumn("task_id", F.lit("never_fails"))
    learnt = []
    build = baseline.shape_baseline
    monkeypatch.setattr(baseline, "shape_baseline", lambda lines, as_of: learnt.append(lines) or build(lines, as_of))
    both = runs.unionByName(healthy)
    assert plan.analyze_tries(both, both, both, AS_OF, 60 * 24 * 60).count() == 4
    assert healthy.count() and {r["task_id"] for r in learnt[0].select("task_id").collect()}.isdisjoint({"never_fails"})


def test_result_rows_keep_both_parts(runs):
    learnt = baseline.shape_baseline(baseline.baseline_lines(runs, runs), datetime(2024, 1, 27, 18))
    analysed = plan.analyze_tries(runs, runs, runs, AS_OF, 60 * 24 * 60, rules.RuleSet(), baseline=learnt)
    rows = {r["run_id"]: r for r in plan.result_rows(analysed, AS_OF).collect()}
    assert rows["r006"]["baseline_comparison"]["baseline_age_days"] == 3
    assert rows["r008"]["baseline_comparison"]["baseline_age_days"] == 0
    assert rows["r006"]["analysis"]["error_message"] == "[a] boom in x" and len({r["id"] for r in rows.values()}) == 4
    assert [line["message"] for line in rows["r006"]["analysis"]["related_logs"]][:1] == ["[a] boom in x"]
    assert all(r["success"] and r["error_message"] is None for r in rows.values())
    asked = plan.with_steps(analysed.withColumns({"steps": F.when(F.col("run_id") == "r008", F.lit("1. look\n- restart")),
                                                  "why": F.when(F.col("run_id") == "r007", F.lit("no answer"))}), "steps")
    rows = {r["run_id"]: r for r in plan.result_rows(asked, AS_OF, "why").collect()}
    assert (rows["r007"]["success"], rows["r007"]["analysis"], rows["r007"]["baseline_comparison"], rows["r007"]["error_message"]) == (False, None, None, "no answer")
    assert rows["r008"]["analysis"]["suggested_actions"] == ["look", "restart"]
    assert rows["r006"]["analysis"]["suggested_actions"] == fv.NO_ANSWER_STEPS and rows["r009"]["analysis"]["suggested_actions"] == [fv.REVIEW_MANUALLY]


def random_runs(spark, n=120):
    """One task holds most runs, as a hot key would."""
    rng = random.Random(3)
    words = ["load", "table", "read", "rows", "failed", "host", "7", "x9", "done", "deadbeef_cafebabe_12345678"]
    rows = []
    for i in range(n):
        log = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(0, 15)))
        task = "hot" if rng.random() < 0.7 else f"t{rng.randint(0, 3)}"
        rows.append(run("d", task, i, rng.choice(["success", "failed"]), log))
    return spark.createDataFrame(rows, RUN)


def test_tree_novelty_equals_brute_force_and_ignores_partitioning(spark):
    table = random_runs(spark).cache()
    failed = table.filter("state = 'failed'")
    results = []
    for parts in (1, 7):
        learnt = baseline.tree_baseline(baseline.baseline_lines(table.repartition(parts), table), AS_OF)
        found = novelty.novel_lines(novelty.tree_novelty(failed.repartition(parts), learnt))
        results.append({(r["run_id"], r["line_number"]) for r in found.collect()})
    assert results[0] == results[1]

    normal = {r["m"]: r["n"] for r in logs.log_entries(table).select(F.col("message").alias("m"), templates.normalise(F.col("message")).alias("n")).collect()}
    picked = {r["run_id"] for r in tasks.recent_successes(table).collect()}
    expected = set()
    by_task = {}
    for row in sorted(table.collect(), key=lambda r: r["run_id"]):
        if row["run_id"] in picked:
            tree = by_task.setdefault(row["task_id"], TemplateTree())
            for line in row["log_content"].split("\n"):
                if line.strip():
                    tree.add(normal[line.strip()].split(" "))
    remasked = dict(normal)
    texts = spark.createDataFrame([(t,) for tree in by_task.values() for _, t, _ in tree.templates()], "t string")
    remasked.update({r["t"]: r["n"] for r in texts.select("t", templates.normalise(F.col("t")).alias("n")).collect()})
    for row in failed.collect():
        seen = by_task.get(row["task_id"])
        tree = TemplateTree()
        for _, template, _ in seen.templates() if seen else ():
            tree.add(remasked[template].split(" "))
        for number, line in enumerate(row["log_content"].split("\n"), start=1):
            if line.strip() and (not seen or tree.add(normal[line.strip()].split(" "))[0] == CREATED):
                expected.add((row["run_id"], number))
    assert results[0] == expected


def test_shape_novelty_does_not_depend_on_salts(spark):
    table = random_runs(spark)
    failed = table.filter("state = 'failed'")
    learnt = baseline.shape_baseline(baseline.baseline_lines(table, table), AS_OF)
    sent, one, many = ({(r["run_id"], tuple(r["known"] or ())) for r in novelty.attach_known(failed, learnt, **how).collect()}
                       for how in ({}, {"salts": 1, "max_bytes": 0}, {"salts": 5, "max_bytes": 0}))
    assert sent == one == many and len(one) == failed.count()


def test_texts_are_joined_either_way(spark):
    table = random_runs(spark)
    keys = table.filter("state = 'failed'").select("run_id", "start_date")
    found = [{r["run_id"] for r in join_measured(table.select("run_id", "log_content"), keys, ["run_id"], "t", limit).collect()} for limit in (0, 10 ** 9)]
    assert found[0] == found[1] == {r["run_id"] for r in keys.collect()}


def test_no_text_is_shuffled_while_keys_are_small(runs):
    joined = tasks.run_logs(runs, runs, runs)
    plan_text = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan_text and "Exchange hashpartitioning" not in plan_text


def test_baseline_state(spark, runs):
    learnt = baseline.shape_baseline(baseline.baseline_lines(runs, runs), datetime(2024, 1, 23, 12))
    state = {r["task_id"]: r for r in baseline.baseline_state(runs, learnt, AS_OF).collect()}
    assert (state["t"]["age_days"], state["t"]["is_stale"]) == (7, True)
    assert (state["new"]["age_days"], state["new"]["cluster_count"], state["new"]["is_stale"]) == (0, 0, True)
    assert baseline.retain(learnt, AS_OF, 7).count() == learnt.count() and baseline.retain(learnt, AS_OF, 6).count() == 0
    assert baseline.clear(learnt, "d", "t").count() == 0
    stats = baseline.statistics(learnt, AS_OF).first()
    assert (stats["total_baselines"], stats["stale"], stats["fresh"]) == (1, 1, 0)
    assert baseline.statistics(learnt.limit(0), AS_OF).first()["average_age_days"] == 0.0


def test_line_filters_strip_each_line_once(spark, runs):
    """A rule filter must not pull the line parsing into every one of its tests."""
    kept = logs.log_entries(runs).filter(~rules.any_rule(rules.shipped_rules(), rules.line_view(F.col("message"))))
    text = kept._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("btrim") + text.count("trim(both") <= 2


# ---------------------------------------------------------------- reports, queue, alerts


@pytest.mark.parametrize("recent, week, expected", [
    (5, 30, (76, "good", "degrading")), (0, 0, (100, "excellent", "stable")), (1, 14, (90, "excellent", "improving")), (70, 70, (0, "critical", "degrading"))])
def test_health(spark, recent, week, expected):
    h = spark.range(1).select(reports.health_from_counts(F.lit(recent), F.lit(week)).alias("h")).first()["h"]
    assert (h["health_score"], h["status"], h["trend"]) == expected


def test_recipients_first_match_wins_from_the_start(spark):
    frame = spark.createDataFrame([("d", "t"), ("xd", "t"), ("d", "u")], "dag_id string, task_id string")
    found = frame.select(alerts.recipients(alerts.task_key(), {"d.t": ["1"], "d": ["2", "3"]}, ["9"])).collect()
    assert [r[0] for r in found] == [["1"], ["9"], ["2", "3"]]


def test_pattern_table_equals_trying_each_pattern(spark):
    import re as regex

    make = random.Random(4)
    patterns = ["dag_1", r"dag_\d+\.load", "(?i)DAG_2.*x", ".*", "(a|b)c+", "", "[", r"etl\.(daily)+_run$", "ab?c", r"\w+", "x{2,}y", "é.l", r"dag_3\.(load|save)", "zz(?:top)?"]
    keys = [make.choice(["dag_1", "dag_2", "dag_33", "etl", "ab", "xxy", "zz", "É", "é"]) + "." + make.choice(["load", "save", "daily_run", "dailydaily_run", "x", "cc", ""]) for _ in range(120)] + ["", "acb", "bcc", "zztop", "xxxyz"]
    for _ in range(4):
        chosen = make.sample(patterns, 8)
        table = spark.createDataFrame([(n, p, [f"{n}"]) for n, p in enumerate(chosen)], "position long, pattern string, recipients array<string>")
        found = alerts.table_recipients(spark.createDataFrame([(k,) for k in keys], "task_key string"), table, ["none"]).collect()

        def first(key):
            for number, pattern in enumerate(chosen):
                if pattern != "[" and regex.match(pattern, key):
                    return [f"{number}"]
            return ["none"]

        assert len(found) == len(keys)
        assert [] == [(row.task_key, row.recipients, first(row.task_key)) for row in found if row.recipients != first(row.task_key)], chosen


def test_reviews_latest_decision(spark):
    queue = spark.createDataFrame([("c1", "pending", "x"), ("c2", "pending", "y")], "id string, status string, human_category string")
    queue = queue.withColumns({"human_severity": F.lit(None).cast("string"), "human_feedback": F.lit(None).cast("string")})
    rows = [("c1", "reject", None, None, "n1", "r", AS_OF), ("c1", "approve", "z", None, "n2", "", AS_OF + timedelta(hours=1))]
    reviews = spark.createDataFrame(rows, "candidate_id string, action string, human_category string, human_severity string, feedback_notes string, reviewer_name string, reviewed_at timestamp_ntz")
    done = {r["id"]: r for r in candidates.apply_reviews(queue, reviews).collect()}
    assert (done["c1"]["status"], done["c1"]["human_category"], done["c1"]["reviewed_by"]) == ("approved", "z", "anonymous")
    assert (done["c2"]["status"], done["c2"]["human_category"], done["c2"]["reviewed_by"]) == ("pending", "y", None)


def test_quality_checks(spark):
    row = spark.range(1).select(schemas.candidate_problems(F.lit("odd"), F.lit(6), F.lit(0.5)), schemas.severity_rank(F.lit("critical"))).first()
    assert row[0] == ["status", "rating"] and row[1] == 4


# ---------------------------------------------------------------- datasets, evaluation, seams


def test_position_is_exact(spark):
    ids = [f"k{n:05d}" for n in range(1000)]
    random.Random(1).shuffle(ids)
    placed = ranking.with_position(spark.createDataFrame([(i,) for i in ids], "id string").repartition(5), "id", partitions=7)
    assert {r["id"]: r["position"] for r in placed.collect()} == {i: n for n, i in enumerate(sorted(ids))}
    assert {r["total"] for r in placed.select("total").distinct().collect()} == {1000}


def test_ordered_split(spark):
    split = datasets.split_ordered(spark.createDataFrame([(n,) for n in range(11)], "id int"), "id")
    assert {r["split"]: r["n"] for r in split.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 8, "validation": 3}
    assert split.filter("split = 'validation'").agg(F.min("id")).first()[0] == 8


def test_ordered_split_of_few_or_no_rows(spark):
    rows = [(None, "a"), ("k1", "b"), ("k2", None), ("k3", ""), ("k4", "e")]
    split = datasets.split_ordered(spark.createDataFrame(rows, "id string, output string"), "id")
    assert {r["id"]: r["split"] for r in split.collect()} == {None: "train", "k1": "train", "k2": "train", "k3": "train", "k4": "validation"}
    whole = datasets.split_ordered(spark.createDataFrame(rows, "id string, output string"), "id", train_ratio=1.0)
    assert {r["split"] for r in whole.collect()} == {"train"}
    nothing = spark.createDataFrame([], "id string, output string")
    assert datasets.split_ordered(nothing, "id").count() == 0
    assert datasets.ordered_info(nothing).first().asDict() == {"train_size": 0, "validation_size": 0, "total_size": 0, "below_minimum": True}


def test_ordered_info_equals_the_counted_split(spark):
    rows = spark.range(53).select(F.col("id").cast("string").alias("id"))
    assert datasets.ordered_info(rows).first() == datasets.dataset_info(datasets.split_ordered(rows, "id")).select(
        "train_size", "validation_size", "total_size", "below_minimum").first()


def test_random_split_is_repeatable(spark):
    rows = spark.range(5000)
    one = {r["id"] for r in datasets.split_random(rows, "id").filter("split = 'train'").collect()}
    two = {r["id"] for r in datasets.split_random(rows.repartition(9), "id").filter("split = 'train'").collect()}
    assert one == two and 3800 < len(one) < 4200
    assert one != {r["id"] for r in datasets.split_random(rows, "id", seed=1).filter("split = 'train'").collect()}


def test_empty_evaluation(spark):
    nothing = evaluation.score(spark.createDataFrame([], "generated string, expected string"))
    assert evaluation.summary(nothing).first()["accuracy"] is None


def test_answer_provider_survives_failures(spark):
    def provider(texts):
        if "bad" in texts:
            raise RuntimeError
        return [t + "!" for t in texts]

    frame = spark.createDataFrame([("a",), ("bad",)], "prompt string").coalesce(1)
    assert {r["prompt"]: r["answer"] for r in extension.with_answers(frame, provider, batch=1).collect()} == {"a": "a!", "bad": None}


def test_failing_user_code_loses_only_its_own_rows(spark):
    def provider(texts):
        if "bad" in texts:
            raise ValueError("bad")
        return [text + "!" for text in texts]

    def test(messages):
        if (messages == "bad").any():
            raise ValueError("bad")
        return messages.str.len() == 1

    predicate = extension.vectorised_predicate(test)
    for parts in (1, 3):
        frame = spark.createDataFrame([("a",), ("bad",), ("bb",), ("c",)], "prompt string").repartition(parts)
        found = {r["prompt"]: r["answer"] for r in extension.with_answers(frame, provider).collect()}
        assert found == {"a": "a!", "bad": None, "bb": "bb!", "c": "c!"}
        matched = {r["prompt"] for r in frame.filter(predicate({"message": F.col("prompt")})).collect()}
        assert matched == {"a", "c"}


def test_stale_baseline_without_replacement_stays(spark):
    old, now = datetime(2024, 1, 1), datetime(2024, 3, 1)
    schema = "dag_id string, task_id string, template string, size long, created_at timestamp_ntz, last_updated timestamp_ntz"
    stored = spark.createDataFrame([("d", "a", "x", 1, old, old), ("d", "b", "y", 1, old, old)], schema)
    rebuilt = spark.createDataFrame([("d", "b", "z", 1, now, now)], schema)
    tasks = stored.select("dag_id", "task_id")
    assert {(r.task_id, r.template) for r in baseline.refresh(tasks, stored, rebuilt, now).collect()} == {("a", "x"), ("b", "z")}


def test_nested_lists_are_measured_with_what_they_hold(spark):
    rows = spark.range(2).select("id", F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda n: F.struct(n.alias("n"), F.lit("x" * 20).alias("name"))).alias("entries"))
    assert not measured(rows, "nested", 100_000)[1] and measured(rows, "nested", 1_000_000)[1]
    empty = spark.sql("SELECT CAST(NULL AS array<struct<n: int, name: string>>) AS entries, map('a', 'b') AS kept, CAST(NULL AS binary) AS raw")
    assert measured(empty, "nested", 1000)[1] and not measured(empty, "nested", 1)[1]


def test_patterns_that_share_a_long_literal_are_filed_apart(spark):
    rows = [(n, rf"dag_1\.task_[0-9]\.run_{10_000 + n}$", [f"{n}"]) for n in range(3000)]
    table = spark.createDataFrame(rows, "position long, pattern string, recipients array<string>")
    known = pattern_index.read_patterns(table, "recipients")
    fullest = pattern_index.filed(known).groupBy("gram").count().agg(F.max("count")).first()[0]
    assert fullest <= 5
    keys = spark.createDataFrame([("dag_1.task_4.run_10007",), ("dag_1.task_4.run_100070",), ("dag_2.task_4.run_10007",), ("DAG_1.task_4.run_12999",)], "task_key string")
    found = {row.task_key: row.recipients for row in alerts.table_recipients(keys, table, ["none"]).collect()}
    assert found == {"dag_1.task_4.run_10007": ["7"], "dag_1.task_4.run_100070": ["none"], "dag_2.task_4.run_10007": ["none"], "DAG_1.task_4.run_12999": ["none"]}


def test_seeds_are_normalised_once_a_task_and_short_logs_are_fed_line_by_line(spark):
    """The plan normalises no template beside a try, and any mixture of repeats gives what line by line gives."""
    tries = spark.createDataFrame([("d", "t", f"r{number}", 1, "alpha 1 beta\nalpha 2 beta\n gamma  delta\nalpha 3 beta\nnew words here") for number in range(3)],
                                  "dag_id string, task_id string, run_id string, try_number long, log_content string").withColumn("start_date", F.lit(None).cast("timestamp_ntz"))
    known = spark.createDataFrame([("d", "t", 0, "alpha <:NUM:> beta", 3)], "dag_id string, task_id string, cluster_no int, template string, size bigint")
    known = known.withColumn("last_updated", F.lit(None).cast("timestamp_ntz"))
    found = novelty.tree_novelty(tries, known)
    assert "seed_text" not in found.columns and "known" in found.columns
    assert {tuple(line.line_number for line in row.anomalous) for row in found.collect()} == {(3, 5)}
    attached = novelty.attach_known(tries, known, seeds=True)
    assert {row.seed_text for row in attached.collect()} == {'["alpha <:NUM:> beta"]'}
    words = ["a", "b", "c", "<*>", "7", "x1"]
    make = random.Random(11)
    for repeats in (1, 2, 6, 30):
        for _ in range(60):
            pool = [" ".join(make.choice(words) for _ in range(make.randint(0, 5))) for _ in range(6)]
            lines = [make.choice(pool) for _ in range(6 * repeats)]
            places = {}
            for number, line in enumerate(lines):
                places.setdefault(line, []).append(number)
            one, many = TemplateTree(), TemplateTree()
            created = [number for number, line in enumerate(lines) if one.add(line.split(" ") if line else [])[0] == CREATED]
            assert many.feed(places.items()) == created and many.templates() == one.templates()

"""Hand-made rows for the boundaries of the column functions."""

import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tasklore.functions.answers import parse_answer
from tasklore.functions import answers, parsing, prompts, rules, scoring, similarity, templates, text
from tasklore.functions import fixed_values as fv

START = datetime(2024, 1, 5, 6, 7, 8)


def one(spark, value, make):
    """Value of a column expression over one text."""
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def lines(spark, log, **options):
    rows = one(spark, log, lambda c: parsing.structured_lines(c, F.lit(START), **options))
    return [(r["line_number"], r["message"]) for r in rows]


def test_blank_lines_count_in_numbering(spark):
    assert lines(spark, "a\n\n b ") == [(1, "a"), (3, "b")]


def test_tail_is_cut_before_numbering(spark):
    assert lines(spark, "l1\nl2\nl3\nl4\nl5", max_lines=2) == [(1, "l4"), (2, "l5")]
    assert lines(spark, "only", max_lines=2) == [(1, "only")]
    assert lines(spark, "") == []


@pytest.mark.parametrize("line, iso, expected", [
    ("[2024-02-03 04:05:06] x 2025-01-01 00:00:00", False, datetime(2024, 2, 3, 4, 5, 6)),
    ("2024-13-99 00:00:00 x", False, START),
    ("no time", False, START),
    ("[2025-08-10T16:13:23.597+0600] x", False, START),
    ("[2025-08-10T16:13:23.597+0600] x", True, datetime(2025, 8, 10, 16, 13, 23)),
])
def test_event_time(spark, line, iso, expected):
    assert one(spark, line, lambda c: parsing.event_time(c, F.lit(START), iso)) == expected


@pytest.mark.parametrize("line, expected", [
    ("x warning: y", "WARNING"), ("WARN x", "INFO"), ("errors", "INFO"), ("info then ERROR", "INFO"), ("[fatal]", "FATAL")])
def test_level(spark, line, expected):
    assert one(spark, line, parsing.level) == expected


def test_strip_removes_every_kind_of_whitespace(spark):
    raw = "\t\x0b  a b　\x1f\n"
    assert one(spark, raw, text.strip) == raw.strip() == "a b"
    assert one(spark, " \t ", text.strip) == ""


@pytest.mark.parametrize("offset, shift", [
    ("+06:30", timedelta(hours=6, minutes=30)), ("-03:00", -timedelta(hours=3)), ("+00:00", None), ("+6h", None), ("+1:2:3", None)])
def test_offset(offset, shift):
    assert parsing.parse_offset(offset) == shift


def test_time_text(spark):
    rows = [(datetime(2024, 1, 2, 3, 4, 5),), (datetime(2024, 1, 2, 3, 4, 5, 120),)]
    frame = spark.createDataFrame(rows, "t timestamp_ntz")
    assert [r[0] for r in frame.select(text.time_text(F.col("t"))).collect()] == [str(r[0]) for r in rows]
    assert [r[0] for r in frame.select(text.time_text(F.col("t"), "T")).collect()] == [r[0].isoformat() for r in rows]


def test_text_cuts(spark):
    assert one(spark, "x" * 161, text.short_text) == "x" * 157 + "..."
    assert one(spark, "x" * 160, text.short_text) == "x" * 160
    assert one(spark, "y" * 101, text.preview) == "y" * 100 + "..."


@pytest.mark.parametrize("pattern, name, hit", [
    ("etl_*", "ETL_daily", True), ("etl_?", "etl_10", False), ("[a-c]x", "bx", True), ("[!a-c]x", "bx", False),
    ("a.b", "axb", False), ("*", "", True), ("a[b", "a[b", True)])
def test_glob(spark, pattern, name, hit):
    assert one(spark, name, lambda c: text.matches_glob(c, pattern)) is hit


# The masks in their plain, backtracking form; the shipped patterns must accept the same texts.
PLAIN = [
    (r"((?<=[^A-Za-z0-9])|^)(([0-9a-f]{2,}:){3,}([0-9a-f]{2,}))((?=[^A-Za-z0-9])|$)", "ID"),
    (r"((?<=[^A-Za-z0-9])|^)(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})((?=[^A-Za-z0-9])|$)", "IP"),
    (r"((?<=[^A-Za-z0-9])|^)([0-9a-f]{6,} ?){3,}((?=[^A-Za-z0-9])|$)", "SEQ"),
    (r"((?<=[^A-Za-z0-9])|^)([0-9A-F]{4} ?){4,}((?=[^A-Za-z0-9])|$)", "SEQ"),
    (r"((?<=[^A-Za-z0-9])|^)(0x[a-f0-9A-F]+)((?=[^A-Za-z0-9])|$)", "HEX"),
    (r"((?<=[^A-Za-z0-9])|^)([\-\+]?\d+)((?=[^A-Za-z0-9])|$)", "NUM"),
    (r"(?<=executed cmd )(\".+?\")", "CMD"),
]


def test_masks_equal_their_plain_form(spark):
    rng = random.Random(7)
    pieces = ["deadbe", "abcdef", "0123456789ab", "a1b2c3d4e5f6a7b8c9", "abc", "g", "Z", " ", " ", "  ", ":", "ab:", "00:1a:", "10.0.0.1", ".",
              "0x1F", "-5", "+7", "--3", "12", "_", "ABCD", "12AB", "executed cmd ", '"ls -l"', "é", "-", ",", "]"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))).strip() for _ in range(4000)]
    texts += ["a" * 60 + "z", "deadbeef cafebabe 12345678 x", "executed cmd \"a\" \"b\"", ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", templates.mask(F.col("t")).alias("m"))

    def plain(value):
        for pattern, name in PLAIN:
            value = re.sub(pattern, f"<:{name}:>", value)
        return value

    for row in frame.collect():
        if len(row["t"]) < 60:
            assert row["m"] == plain(row["t"]), row["t"]


def test_long_hex_run_is_linear(spark):
    assert one(spark, "a" * 50_000 + "z", templates.mask) == "a" * 50_000 + "z"


def test_shape_template(spark):
    assert one(spark, "[x1] at 10.0.0.1 took -5 ms_total part_12.csv", templates.shape_template) == "<*> at <:IP:> took <:NUM:> ms total part <:NUM:>.csv"
    assert one(spark, "", templates.tokenize) == []
    assert one(spark, "a_b  c", templates.tokenize) == ["a", "b", "c"]


def matches(spark, message, rule, predicates=None, level="INFO"):
    frame = spark.createDataFrame([(message, level)], "message string, level string")
    line = rules.line_view(F.col("message"), level=F.col("level"))
    return frame.select(rules.rule_test(rule, line, predicates)).first()[0]


@pytest.mark.parametrize("message, rule, expected", [
    ("ab Xc", rules.Rule("regex", "x"), True),
    ("ab Xc", rules.Rule("regex", "x", case_sensitive=True), False),
    ("ab", rules.Rule("regex", ".*B.*"), True),
    ("ab", rules.Rule("regex", "(", negate=True), False),
    ("aa bb", rules.Rule("regex", r"(?P<first_one>a)(?P=first_one).*b\Z"), True),
    ("ab", rules.Rule("substring", "AB", negate=True), False),
    ("ab", rules.Rule("starts_with", "B"), False),
    ("ab", rules.Rule("ends_with", "B"), True),
    ("123456789", rules.Rule("length_threshold", "10"), True),
    ("1234567890", rules.Rule("length_threshold", "10"), False),
    ("x", rules.Rule("length_threshold", "ten", negate=True), False),
    ("x", rules.Rule("custom_function", "nobody", negate=True), False),
])
def test_rules(spark, message, rule, expected):
    assert matches(spark, message, rule) is expected


def test_predicates(spark):
    def broken(line):
        raise RuntimeError

    assert matches(spark, "x", rules.Rule("custom_function", "b", negate=True), {"b": broken}) is False
    assert matches(spark, "x", rules.Rule("custom_function", "n", negate=True), {"n": lambda line: F.lit(None).cast("boolean")}) is False
    assert matches(spark, "x", rules.Rule("custom_function", "e"), {"e": lambda line: line["level"] == "ERROR"}, "ERROR") is True


@pytest.mark.parametrize("pattern, bare", [
    (".*a.*", "a"), (r"a\.*", r"a\.*"), (".*?a", ".*?a"), (".*", ""), ("a|.*b", "a|.*b")])
def test_bare_search(pattern, bare):
    assert rules.bare_search(pattern) == bare
    for sample in ("", "a", "ba.", "b", "a..", "xay"):
        assert bool(re.search(pattern, sample)) == bool(re.search(bare, sample))


def test_rule_loading_replaces_defaults_and_skips_bad_entries():
    assert rules.load_rules(None) == rules.default_rules()
    assert rules.load_rules({"classifier": {}}) == rules.default_rules()
    loaded = rules.load_rules({"filter_rules": ["no", {"type": "what", "pattern": "x"}, {"type": "regex"}, {"type": "regex", "pattern": "x", "negate": True}]})
    assert loaded.rules == (rules.Rule("regex", "x", negate=True),)
    assert len(rules.default_rules().rules) == 9 and len(rules.shipped_rules().rules) == 33


def test_score_loading():
    assert rules.load_score(None) == rules.load_score({"classifier": ["no"]}) == rules.load_score({"classifier": {}}) == rules.ScoreSettings()
    loaded = rules.load_score({"classifier": {"error_indicators": ["boom"], "min_confidence_score": 0.2}})
    assert (loaded.indicators, loaded.levels, loaded.threshold) == (("boom",), rules.ScoreSettings().levels, 0.2)
    assert rules.load_score({"filter_rules": []}, rules.SHIPPED_SCORE) == rules.SHIPPED_SCORE


def test_two_entry_smoke(spark):
    shipped = rules.shipped_rules()
    assert one(spark, "Task exited with return code 0", lambda c: rules.any_rule(shipped, rules.line_view(c))) is True
    assert one(spark, "Connection refused to database", lambda c: rules.any_rule(shipped, rules.line_view(c))) is False


def test_presets(spark):
    notify = rules.preset("notification", rules.NoiseSettings(sms_enabled=False))

    def label(message):
        return one(spark, message, lambda c: rules.first_rule(notify, rules.line_view(c)))

    assert label("[t] Caused by: x9") is None
    assert label("plain line without mark") == "Standard Error Log"
    assert label("code TPT1234 line") is None
    assert label("[t] SMS gateway disabled") == "SMS disabled messages"
    assert label("[t] DEBUG something") == "Debug messages (not in debug mode)"
    with pytest.raises(ValueError):
        rules.preset("nothing")


def test_error_score(spark):
    score = one(spark, "Traceback failed error", lambda c: rules.error_score(c, F.lit("ERROR")))
    assert score == pytest.approx(1.7)
    assert one(spark, "fine", lambda c: rules.error_score(c, F.lit("INFO"))) == 0.0
    assert one(spark, "error error", lambda c: rules.error_score(c, F.lit("INFO"))) == 0.2


@pytest.mark.parametrize("error, expected", [
    ("tbuild timeout", "configuration_error"), ("read timeout", "timeout_error"), ("file not found", "data_quality"),
    ("Deadlock", "resource_error"), ("connection lost", "configuration_error"), ("else", "unknown")])
def test_category(spark, error, expected):
    assert one(spark, error, scoring.category) == expected


def test_rating(spark):
    assert one(spark, "FATAL x", scoring.severity) == "high"
    assert one(spark, "an error here", scoring.confidence) == 0.85
    assert one(spark, "short!", scoring.confidence) == 0.70
    assert one(spark, "x", scoring.confidence) == 0.50
    assert one(spark, "file is missing", scoring.rate_candidate)["confidence"] == 0.85
    assert one(spark, "permission_error", scoring.reasoning) == fv.REASONING_DEFAULT


def error_line(spark, rows):
    frame = spark.createDataFrame([(rows,)], "l array<struct<level:string,message:string>>")
    return frame.select(scoring.error_line(F.col("l"))).first()[0]


def test_error_line(spark):
    assert error_line(spark, [("INFO", "it failed"), ("ERROR", "b"), ("FATAL", "c")]) == "b"
    assert error_line(spark, [("INFO", "a"), ("INFO", "it failed")]) == "it failed"
    assert error_line(spark, [("INFO", "a"), ("INFO", "z")]) == "z"
    assert error_line(spark, []) == fv.NO_DETAILS


def test_answers(spark):
    good = one(spark, '```json\n{"error_message": "m", "confidence": 0.9, "category": "timeout_error", "severity": "high", "error_lines": ["l"]}\n```', answers.parse_answer)
    assert (good["error_message"], good["confidence"], good["raw_error_lines"], good["reasoning"]) == ("m", 0.9, ["l"], "")
    empty = one(spark, "{}", answers.parse_answer)
    assert (empty["error_message"], empty["confidence"], empty["category"], empty["severity"]) == ("Unknown error", 0.5, "unknown", "medium")
    for bad in ("```\n{}\n```", "no json", '{"category": "x"}', '{"confidence": "high"}', ""):
        assert one(spark, bad, answers.parse_answer)["error_message"] == "Analysis failed: Parse error"
    assert one(spark, "```x\ntimeout_error\n```", answers.parse_category) == "timeout_error"
    assert one(spark, "a|b", answers.parse_category) == "unknown"


def test_steps(spark):
    assert one(spark, "1. A\n- B\nc\n* ", answers.parse_steps) == ["A", "B"]
    assert one(spark, "nothing", answers.parse_steps) == [fv.NO_STEPS]


def test_prompts(spark):
    frame = spark.createDataFrame([("d", None)], "dag string, log string")
    prompt = prompts.render("p", {"dag": F.col("dag"), "log": F.col("log")}, templates={"p": "{{x}} {dag}|{log}{few_shot_examples}"},
                            examples=[(str(n), "a") for n in range(7)])
    rendered = frame.select(prompt).first()[0]
    assert rendered.startswith("{x} d|\nExample 1:") and "Example 5:" in rendered and "Example 6:" not in rendered
    with pytest.raises(ValueError):
        prompts.render("none", {})


def test_similarity(spark):
    frame = spark.createDataFrame([("a b", "b c"), ("", " "), ("a", "")], "l string, r string")
    assert [r[0] for r in frame.select(similarity.jaccard(F.col("l"), F.col("r"))).collect()] == [pytest.approx(1 / 3), 1.0, 0.0]
    assert one(spark, " Error:  The error is: x  y ", similarity.clean) == "x y"
    assert one(spark, "plain", lambda c: similarity.term_recall(c, c)) is False
    assert one(spark, 'Error 12 Timeout "" "q" AB[1]', similarity.error_terms) == ["Error 12", "Timeout", "AB[1]", "", "q"]


def test_redact(spark):
    masked = one(spark, "mail a.b@c.org from 10.1.2.3 token=abc123 id 123456789 " + "f" * 32, text.redact)
    assert masked == "mail <EMAIL> from <ADDRESS> token=<SECRET> id <DIGITS> <HEX>"


def test_answers_must_be_one_object_with_texts(spark):
    texts = ['{"error_message":"x"}', '{"error_message":"x"} trailing', '{"error_message":null}', '{"error_message":3}', '{"category":null}',
             '{"confidence":null}', '{"error_message":"x"},{"a":1}']
    frame = spark.createDataFrame(list(enumerate(texts)), "id int, answer string").orderBy("id")
    found = [row[0] for row in frame.select(parse_answer(frame.answer)["error_message"]).collect()]
    assert found[0] == "x" and len(set(found[1:])) == 1 and found[1] != "x"


def test_rules_fold_case_of_all_scripts(spark):
    frame = spark.createDataFrame([("über alles",), ("UBER",)], "message string")
    test = rules._test(rules.Rule("regex", r"\b(ÜBER|finished)\b"), {"message": F.col("message")}, {})
    assert [row.message for row in frame.filter(test).collect()] == ["über alles"]

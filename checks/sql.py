"""DuckDB building blocks of the oracles, written independently of the Spark expressions."""

from __future__ import annotations

from tasklore.functions import fixed_values as fv

# Whitespace as str.strip() sees it, in RE2 syntax.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def squeeze(x: str) -> str:
    return f"regexp_replace({strip(x)}, '{WS}+', ' ', 'g')"


def any_of(x: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(t)})" for t in terms) + ")"


def half_up(x: str, digits: int) -> str:
    scale = float(10 ** digits)
    return f"floor(({x}) * {scale}::DOUBLE + 0.5) / {scale}::DOUBLE"


def _unsigned(x: str, core: str, name: str) -> str:
    one = "regexp_replace({x}, '(^|[^A-Za-z0-9])" + core.replace("{", "{{").replace("}", "}}") + \
        "($|[^A-Za-z0-9])', '\\1<:" + name + ":>\\2', 'g')"
    return one.format(x=one.format(x=x))


def mask(x: str) -> str:
    """RE2 has no look-around: context is captured, and each replacement runs twice for touching hits."""
    for core, name in [
        ("(?:(?:[0-9a-f]{2,}:){3,}(?:[0-9a-f]{2,}))", "ID"),
        (r"(?:[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})", "IP"),
        ("(?:[0-9a-f]{6,} ?){3,}", "SEQ"),
        ("(?:[0-9A-F]{4} ?){4,}", "SEQ"),
        ("(?:0x[a-f0-9A-F]+)", "HEX"),
    ]:
        x = _unsigned(x, core, name)
    mark = "'Q' || chr(3) || 'Q'"
    x = f"replace({x}, '_', chr(2))"
    x = f"regexp_replace({x}, '\\b[0-9]+\\b', {mark}, 'g')"
    x = f"regexp_replace({x}, '(^|[^A-Za-z0-9])[-+]Q' || chr(3) || 'Q', '\\1Q' || chr(3) || 'Q', 'g')"
    x = f"replace(replace({x}, {mark}, '<:NUM:>'), chr(2), '_')"
    return f"regexp_replace({x}, '(executed cmd )\".+?\"', '\\1<:CMD:>', 'g')"


def normal(x: str) -> str:
    return squeeze(f"replace({mask(x)}, '_', ' ')")


def shape(x: str) -> str:
    return f"regexp_replace({normal(x)}, '[^ ]*[0-9][^ ]*', '<*>', 'g')"


def lines(source: str, cap: int = 2**31 - 2) -> str:
    """Structured lines of a (dag_id, task_id, run_id, try_number, start_date, log_content) source."""
    return f"""
SELECT dag_id, task_id, run_id, try_number, line_number, line_number + skipped AS orig_line_number,
  coalesce(try_strptime(nullif(regexp_extract(raw_content, '([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}})', 1), ''), '%Y-%m-%d %H:%M:%S'), start_date) AS ts,
  coalesce(nullif(upper(regexp_extract(raw_content, '(?i)\\b(DEBUG|INFO|WARNING|ERROR|CRITICAL|FATAL)\\b', 1)), ''), 'INFO') AS level,
  {strip('raw_content')} AS message, raw_content
FROM (SELECT dag_id, task_id, run_id, try_number, start_date, greatest(len(parts) - {cap}, 0) AS skipped,
        unnest(parts[greatest(len(parts) - {cap} + 1, 1):]) AS raw_content,
        unnest(range(1, least(len(parts), {cap}) + 1)) AS line_number
      FROM (SELECT *, string_split(log_content, chr(10)) AS parts FROM {source}) split_logs) numbered
WHERE {strip('raw_content')} <> ''"""


def rule(kind: str, pattern: str, x: str = "message") -> str:
    if kind == "regex":
        return f"regexp_matches({x}, {lit(pattern)}, 'i')"
    if kind == "length_threshold":
        return f"length({strip(x)}) < {pattern}"
    test = {"substring": "contains", "starts_with": "starts_with", "ends_with": "ends_with"}[kind]
    return f"{test}(lower({x}), {lit(pattern.lower())})"


SPAM = any_of("message", fv.NOTIFICATION_SPAM)
NOT_STANDARD = ("(NOT contains(message, 'Caused by') AND NOT (starts_with(message, '[') OR starts_with(message, '$') "
                "OR regexp_matches(message, 'TPT[0-9]+')))")
CONFIG_NOISE = any_of("message", ["timezone offset +00:00", "Using ollama provider", "Configuration loaded"])
NOTIFICATION = [(rule(k, p), d) for k, p, d in fv.SHIPPED_RULES] + [
    (SPAM, "Messages that create notification spam"),
    (CONFIG_NOISE, "Configuration-related noise"),
    (NOT_STANDARD, "Standard Error Log"),
    (rule("regex", r".*\b(DEBUG|debug)\b.*"), "Debug messages (not in debug mode)"),
]


def first_rule(rules: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {lit(label)}" for test, label in rules) + " END"


def category(x: str) -> str:
    arms = " ".join(f"WHEN {any_of(f'lower({x})', terms)} THEN '{name}'" for name, terms in fv.CATEGORY_TERMS)
    return f"CASE {arms} ELSE 'unknown' END"


def severity(x: str) -> str:
    return f"CASE WHEN {any_of(f'lower({x})', fv.HIGH_SEVERITY_TERMS)} THEN 'high' ELSE 'medium' END"


def confidence(x: str) -> str:
    return (f"CAST(CASE WHEN length({x}) > 10 AND contains(lower({x}), 'error') THEN 0.85 "
            f"WHEN length({x}) > 5 THEN 0.7 ELSE 0.5 END AS DOUBLE)")


def reasoning(x: str) -> str:
    arms = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fv.REASONING.items())
    return f"CASE {x} {arms} ELSE {lit(fv.REASONING_DEFAULT)} END"


def clean(x: str) -> str:
    x = squeeze(x)
    for prefix in fv.ANSWER_PREFIXES:
        x = f"(SELECT CASE WHEN starts_with(c, {lit(prefix)}) THEN {strip(f'substr(c, {len(prefix) + 1})')} ELSE c END FROM (SELECT {x} AS c))"
    return x


AGE = "floor((epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(b.last_updated)) / 86400000000.0)"
_KEYWORD = any_of("lower(message)", fv.ERROR_KEYWORDS)

# Views shared by several oracles, on top of the canonical ones.
VIEWS = {
    "run_lines": lines("task_runs"),
    "shaped_lines": f"SELECT *, {shape('message')} AS template FROM run_lines",
    "doc_lines": f"""
SELECT doc_id, line_number, {strip('raw_content')} AS message
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw_content,
        unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_number FROM documents) d
WHERE {strip('raw_content')} <> ''""",
    "base_runs": """
SELECT * FROM (SELECT dag_id, task_id, run_id, try_number, state, start_date, end_date, log_content,
    row_number() OVER (PARTITION BY dag_id, task_id ORDER BY end_date DESC, run_id) AS recency
  FROM task_runs WHERE state = 'success' AND try_number = 1) ranked WHERE recency <= 3""",
    "base_lines": lines("base_runs"),
    "base_templates": f"""
SELECT dag_id, task_id, template, count(*) AS size,
  row_number() OVER (PARTITION BY dag_id, task_id ORDER BY template) - 1 AS cluster_no
FROM (SELECT dag_id, task_id, {shape('message')} AS template FROM base_lines) shaped GROUP BY dag_id, task_id, template""",
    "fail_tries": """
SELECT t.* FROM task_tries t WHERE t.state = 'failed' AND t.try_number > 0
  AND EXISTS (SELECT 1 FROM task_fail f WHERE f.dag_id = t.dag_id AND f.task_id = t.task_id AND f.run_id = t.run_id)""",
    "fail_lines": lines("fail_tries"),
    "fail_marked": f"""
SELECT l.*, b.dag_id IS NOT NULL AS has_baseline,
  b.dag_id IS NULL OR (NOT EXISTS (SELECT 1 FROM base_templates k WHERE k.dag_id = l.dag_id AND k.task_id = l.task_id AND k.template = l.template)
    AND row_number() OVER (PARTITION BY l.dag_id, l.task_id, l.run_id, l.try_number, l.template ORDER BY l.line_number) = 1) AS anomalous
FROM (SELECT *, {shape('message')} AS template FROM fail_lines) l
LEFT JOIN (SELECT DISTINCT dag_id, task_id FROM base_templates) b ON b.dag_id = l.dag_id AND b.task_id = l.task_id""",
    "fail_ruled": f"SELECT *, {first_rule(NOTIFICATION)} AS matched_rule FROM fail_marked",
    "fail_stats": """
SELECT t.dag_id, t.task_id, t.run_id, t.try_number, count(m.line_number) AS n_lines,
  count_if(m.anomalous) AS n_anomalous, count_if(m.anomalous AND m.matched_rule IS NULL) AS n_candidates
FROM fail_tries t LEFT JOIN fail_ruled m ON m.dag_id = t.dag_id AND m.task_id = t.task_id AND m.run_id = t.run_id AND m.try_number = t.try_number
GROUP BY ALL""",
    "fail_errors": f"""
SELECT dag_id, task_id, run_id, try_number,
  coalesce(min_by(message, line_number) FILTER (level IN ('ERROR', 'CRITICAL', 'FATAL')),
           min_by(message, line_number) FILTER ({_KEYWORD}), max_by(message, line_number)) AS error_line,
  string_agg(message, chr(10) ORDER BY line_number) AS candidate_text
FROM fail_ruled WHERE anomalous AND matched_rule IS NULL GROUP BY ALL""",
    # Stored baselines of different ages, so that age and staleness have something to decide.
    "base_stored": """
SELECT b.dag_id, b.task_id, b.template, b.size, b.cluster_no,
  a.moment AS created_at, a.moment AS last_updated
FROM base_templates b JOIN (SELECT dag_id, task_id, max(end_date) - to_days(CAST(sum(k) % 40 AS INTEGER)) AS moment
  FROM (SELECT dag_id, task_id, end_date, k, row_number() OVER (PARTITION BY dag_id, task_id ORDER BY end_date DESC, run_id) AS recency
        FROM task_runs WHERE state = 'success' AND try_number = 1) r WHERE recency <= 3 GROUP BY ALL) a
  ON a.dag_id = b.dag_id AND a.task_id = b.task_id""",
    "base_state": f"""
SELECT t.dag_id, t.task_id, coalesce(b.cluster_count, 0) AS cluster_count, b.created_at, b.last_updated,
  CAST(coalesce({AGE}, 0) AS BIGINT) AS age_days, b.last_updated IS NULL OR {AGE} >= 7 AS is_stale
FROM (SELECT DISTINCT dag_id, task_id FROM task_runs) t
LEFT JOIN (SELECT dag_id, task_id, count(*) AS cluster_count, min(created_at) AS created_at, max(last_updated) AS last_updated
  FROM base_stored GROUP BY ALL) b ON b.dag_id = t.dag_id AND b.task_id = t.task_id""",
}

"""Prompt texts rendered for a whole column. Templates and examples are parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_EXAMPLES = 5

# Short built-in templates; callers pass their own to override them. Double braces are literal braces.
TEMPLATES = {
    "error_extraction": (
        "Find the root cause in this task log.\n\nLog Context:\n{log_context}\n\n"
        "DAG ID: {dag_id}\nTask ID: {task_id}\n\n"
        'Answer with JSON: {{"error_message": "", "confidence": 0.0, "category": "", "severity": "", '
        '"reasoning": "", "error_lines": []}}\n'
    ),
    "error_categorization": "Name one category for this error.\n\nError: {error_message}\nContext: {context}\n",
    "resolution_suggestion": (
        "List three to five numbered steps that fix this error.\n\n"
        "Error: {error_message}\nCategory: {category}\nSeverity: {severity}\n"
    ),
    "sms_error_extraction": (
        "Return only the main error message of this log, at most 160 characters.\n\n"
        "Log Context:\n{log_context}\n\nDAG ID: {dag_id}\nTask ID: {task_id}\n"
    ),
}
SUFFIXES = {("gemini", "error_extraction"): "\nAnswer with plain JSON, without Markdown.\n"}


def format_examples(examples: Sequence[tuple[str, str]]) -> str:
    """Up to five (log, answer) examples, numbered and separated by dashes."""
    blocks = [f"Example {n}:\nLog Context:\n{log}\n\nExpected Response:\n{answer}\n"
              for n, (log, answer) in enumerate(examples[:MAX_EXAMPLES], start=1)]
    return "\n" + "\n---\n".join(blocks) + "\n---\n"


def render(name: str, values: Mapping[str, Column], provider: str | None = None,
           templates: Mapping[str, str] | None = None,
           examples: Sequence[tuple[str, str]] | None = None) -> Column:
    """Compile the template once on the driver to a concatenation of literals and columns."""
    template = {**TEMPLATES, **(templates or {})}.get(name)
    if template is None:
        raise ValueError(f"unknown prompt template {name!r}")
    template += SUFFIXES.get((provider or "", name), "")
    columns = dict(values)
    if examples:
        columns["few_shot_examples"] = F.lit(format_examples(examples))
    parts: list[Column] = []
    for literal, key, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if key is not None:
            parts.append(F.coalesce(columns[key].cast("string"), F.lit("")))
    return F.concat(*parts)

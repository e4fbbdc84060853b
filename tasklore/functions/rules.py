"""Ordered filter rules compiled to Columns.

A rule list lives on the driver; all rules become one expression, so a line is tested in one pass
without any Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from tasklore.functions import fixed_values as fv
from tasklore.functions import text

KINDS = ("regex", "substring", "custom_function", "starts_with", "ends_with", "length_threshold")

Predicate = Callable[[Mapping[str, Column]], Column]


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    description: str = ""
    case_sensitive: bool = False
    negate: bool = False

    @property
    def label(self) -> str:
        return self.description or self.pattern


@dataclass(frozen=True)
class RuleSet:
    """Rules in order plus the named predicates that ``custom_function`` rules refer to."""

    rules: tuple[Rule, ...] = ()
    predicates: Mapping[str, Predicate] = field(default_factory=dict)

    def add(self, *rules: Rule) -> RuleSet:
        return replace(self, rules=self.rules + rules)

    def register(self, name: str, predicate: Predicate, description: str = "") -> RuleSet:
        """Register a predicate and append a rule that applies it."""
        known = {**self.predicates, name: predicate}
        return replace(self, predicates=known).add(Rule("custom_function", name, description))


def _rules(entries: list[tuple[str, str, str]]) -> tuple[Rule, ...]:
    return tuple(Rule(kind, pattern, description) for kind, pattern, description in entries)


def default_rules() -> RuleSet:
    return RuleSet(_rules(fv.DEFAULT_RULES))


def shipped_rules() -> RuleSet:
    return RuleSet(_rules(fv.SHIPPED_RULES))


def load_rules(config: Any, defaults: RuleSet | None = None) -> RuleSet:
    """Rules from a mapping; a ``filter_rules`` key replaces the defaults, malformed entries are skipped."""
    defaults = default_rules() if defaults is None else defaults
    if not isinstance(config, dict) or "filter_rules" not in config:
        return defaults
    accepted = []
    for entry in config["filter_rules"] or []:
        if isinstance(entry, dict) and entry.get("type") in KINDS and "pattern" in entry:
            accepted.append(Rule(entry["type"], str(entry["pattern"]), entry.get("description", ""),
                                 bool(entry.get("case_sensitive", False)), bool(entry.get("negate", False))))
    return replace(defaults, rules=tuple(accepted))


def bare_search(pattern: str) -> str:
    """Drop a leading and a trailing ``.*``: in a search they change nothing but make every miss quadratic."""
    if re.match(r"\.\*(?![?+*{])", pattern):
        pattern = pattern[2:]
    if re.search(r"(?<!\\)\.\*$", pattern):
        pattern = pattern[:-2]
    return pattern


def java_pattern(pattern: str) -> str:
    """Spell the few constructs that only Python's syntax has in the way the JVM reads them."""
    pattern = re.sub(r"\(\?P<(\w+)>", lambda m: f"(?<{m[1].replace('_', '')}>", pattern)
    pattern = re.sub(r"\(\?P=(\w+)\)", lambda m: rf"\k<{m[1].replace('_', '')}>", pattern)
    return re.sub(r"(?<!\\)\\Z", r"\\z", pattern)


def _test(rule: Rule, line: Mapping[str, Column], predicates: Mapping[str, Predicate]) -> Column | None:
    """The rule's own test, or None when the rule can never match."""
    message = line["message"]
    pattern = rule.pattern
    if rule.kind == "regex":
        try:
            re.compile(pattern)
        except re.error:
            return None
        # (?d): only a line feed ends a line, as for the dot of the rule syntax; (?U): letters, digits and case of all scripts.
        return message.rlike(("(?dU)" if rule.case_sensitive else "(?iduU)") + java_pattern(bare_search(pattern)))
    if rule.kind == "length_threshold":
        try:
            return F.length(text.strip(message)) < int(pattern)
        except ValueError:
            return None
    if rule.kind == "custom_function":
        predicate = predicates.get(pattern)
        if predicate is None:
            return None
        try:
            return predicate(line)
        except Exception:
            return None
    if not rule.case_sensitive:
        message, pattern = line["lowered"], pattern.lower()
    return {"substring": message.contains, "starts_with": message.startswith,
            "ends_with": message.endswith}[rule.kind](pattern)


def rule_test(rule: Rule, line: Mapping[str, Column], predicates: Mapping[str, Predicate] | None = None) -> Column:
    """Does the line match? ``negate`` inverts the test, but an unusable rule never matches."""
    test = _test(rule, line, predicates or {})
    if test is None:
        return F.lit(False)
    return F.coalesce(~test if rule.negate else test, F.lit(False))


def line_view(message: Column, **others: Column) -> dict[str, Column]:
    """The columns a rule may look at, keyed by name."""
    return {"message": message, "lowered": F.lower(message), **others}


def any_rule(rules: RuleSet, line: Mapping[str, Column]) -> Column:
    """True when some rule matches: the line is dropped. Order does not matter for this answer."""
    hit = F.lit(False)
    for rule in rules.rules:
        hit = hit | rule_test(rule, line, rules.predicates)
    return hit


def first_rule(rules: RuleSet, line: Mapping[str, Column]) -> Column:
    """Label of the first matching rule, null when none matches."""
    if not rules.rules:
        return F.lit(None).cast("string")
    found = F  # one flat CASE: when(...).when(...) instead of nested ones
    for rule in rules.rules:
        found = found.when(rule_test(rule, line, rules.predicates), F.lit(rule.label))
    return found


# ---------------------------------------------------------------- named predicates and presets


@dataclass(frozen=True)
class NoiseSettings:
    """Settings the noise phrases mention; values come from the caller's configuration."""

    offset: str = "+00:00"
    provider: str = "ollama"
    verify_ssl: bool = True
    base_url: str = ""
    timeout: int = 30
    depth: int = fv.TREE_DEPTH
    similarity: float = fv.TREE_SIMILARITY
    debug: bool = False
    sms_enabled: bool = True

    def fill(self, phrases: list[str]) -> list[str]:
        ssl = fv.SSL_ON_NOISE if self.verify_ssl else fv.SSL_OFF_NOISE
        return [p.format(ssl=ssl, **self.__dict__) for p in phrases]


def notification_spam(message: Column, phrases: list[str] | None = None) -> Column:
    return text.contains_any(message, fv.NOTIFICATION_SPAM if phrases is None else phrases)


def config_noise(message: Column, settings: NoiseSettings) -> Column:
    phrases = settings.fill(fv.CONFIG_NOISE) + ([] if settings.verify_ssl else [fv.SSL_OFF_NOISE])
    return text.contains_any(message, phrases)


def integration_noise(message: Column, settings: NoiseSettings) -> dict[str, Column]:
    """The four noise groups of the integrated filter, by name."""
    groups = {"timezone": fv.TIMEZONE_NOISE, "scheduler_config": fv.SCHEDULER_NOISE,
              "model": fv.MODEL_NOISE, "clustering": fv.CLUSTERING_NOISE}
    return {name: text.contains_any(message, settings.fill(phrases)) for name, phrases in groups.items()}


def not_standard_line(message: Column) -> Column:
    """True for lines to drop: neither bracketed nor a shell echo nor a coded error, unless they name a cause."""
    standard = message.rlike(fv.STANDARD_LINE_CODE)
    for start in fv.STANDARD_LINE_STARTS:
        standard = standard | message.startswith(start)
    return ~message.contains(fv.STANDARD_LINE_EXEMPT) & ~standard


def notification_rules(base: RuleSet, settings: NoiseSettings) -> RuleSet:
    """Base rules plus spam, configuration noise, non-standard lines and the run-time switches."""
    rules = (
        base.register("notification_spam", lambda line: notification_spam(line["message"]),
                      "Messages that create notification spam")
        .register("config_noise", lambda line: config_noise(line["message"], settings),
                  "Configuration-related noise")
        .register("standard_error_log", lambda line: not_standard_line(line["message"]), "Standard Error Log")
    )
    if not settings.debug:
        rules = rules.add(Rule("regex", *fv.DEBUG_WORD_RULE))
    if not settings.sms_enabled:
        rules = rules.add(Rule("regex", *fv.SMS_OFF_RULE))
    return rules


def preset(name: str, settings: NoiseSettings | None = None, base: RuleSet | None = None) -> RuleSet:
    """``notification``, ``analysis`` or ``monitoring``; the last two use the base rules unchanged."""
    base = shipped_rules() if base is None else base
    if name == "notification":
        return notification_rules(base, settings or NoiseSettings())
    if name in ("analysis", "monitoring"):
        return base
    raise ValueError(f"unknown preset {name!r}")


# ---------------------------------------------------------------- error score


@dataclass(frozen=True)
class ScoreSettings:
    indicators: tuple[str, ...] = tuple(fv.DEFAULT_INDICATORS)
    levels: tuple[str, ...] = tuple(fv.ERROR_LEVELS)
    threshold: float = fv.DEFAULT_SCORE_THRESHOLD


SHIPPED_SCORE = ScoreSettings(tuple(fv.SHIPPED_INDICATORS), tuple(fv.SHIPPED_SCORE_LEVELS), fv.SHIPPED_SCORE_THRESHOLD)


def load_score(config: Any, defaults: ScoreSettings = ScoreSettings()) -> ScoreSettings:
    """Score settings from the ``classifier`` part of the same mapping: keys that are there replace the defaults, a part that is no mapping is skipped."""
    part = config.get("classifier") if isinstance(config, dict) else None
    if not isinstance(part, dict):
        return defaults
    return ScoreSettings(
        tuple(map(str, part.get("error_indicators", defaults.indicators))), tuple(map(str, part.get("error_levels", defaults.levels))),
        float(part.get("min_confidence_score", defaults.threshold)))


def error_score(message: Column, level: Column, settings: ScoreSettings = ScoreSettings()) -> Column:
    """Level, indicator words (capped) and trace marks add up to a score."""
    lowered = F.lower(message)
    hits = F.lit(0)
    for word in settings.indicators:
        hits = hits + F.when(lowered.contains(word), 1).otherwise(0)
    score = F.when(F.upper(level).isin(*settings.levels), fv.LEVEL_SCORE).otherwise(0.0)
    score = score + F.least(F.lit(fv.INDICATOR_SCORE_CAP), hits * F.lit(fv.INDICATOR_SCORE))
    return score + F.when(text.contains_any(message, fv.TRACE_MARKS), fv.TRACE_SCORE).otherwise(0.0)


def is_error_candidate(score: Column, settings: ScoreSettings = ScoreSettings()) -> Column:
    return score >= settings.threshold

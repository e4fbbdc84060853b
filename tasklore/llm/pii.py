"""Operator 6, personal data by weak supervision, with DataFrame functions only.

Strict patterns give the base spans. Looser patterns propose more. Three labelers vote on every candidate: its shape (regex), a list of
known endings, prefixes and codes (gazetteer), and the words around it (context). Votes are counted over all documents; expectation-maximisation
on that table of counts, whose size the number of votes and features bounds, estimates how reliable each labeler is for each kind
and gives every combination a probability; a logistic span classifier is trained on those. Base spans always stay; other
candidates that the classifier accepts, and that overlap no base span, are added.

Everything about a document is computed in its own row: text is neither exploded nor shuffled. Matches are placed by the lengths of
the pieces between them, positions count code points. The patterns are possessive and start only where a run starts, so a text of any
length takes linear time; they match what the plain patterns match.

Defined results: a null text is empty and has no span; null ids and repeated rows are treated row by row; an empty table trains
nothing and gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tasklore.llm.common import kept_names, packed, unpacked, written
from tasklore.operators.logs import pin

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "person")
LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",  # a shorter run can't be a card wherever it starts
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]++(?:\x20?(?:\.|[\[(]\x20?dot\x20?[\])])\x20?[a-z0-9-]++)++",
    "phone": r"(?<![0-9.+-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "secret": r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key)\x20?[=:]\x20?[^\s,;]{6,}+",
    "person": r"\b(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sra?)\.?\x20\p{Lu}\p{Ll}++",
}
CONTEXT_CHARS = 32
BLOCK = 1024
TEXT_BLOCK = 32_768
FAR = (1 << 31) - 1
# What the gazetteer and context labelers know.
ENDINGS = ["com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "uk", "us"]
COUNTRY_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CUES = {
    "email": "mail|contact|write|reach|address", "ip": "ip|host|server|addr|client|login", "card": "card|visa|credit|pay|account",
    "phone": "phone|tel|call|mobile|fax|contact", "secret": "login|user|credential|auth", "person": "dear|by|from|contact|signed",
}
COUNTER_CUES = r"version|release|build|isbn|serial|order|invoice|doi|chapter"
PLACEHOLDERS = r"(?i)x{4,}|\*{3,}|example|changeme|your[_-]"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once; an expression inside a lambda is computed for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Sums, or greatest values, of an integer array up to each element, from 0 on. Blocks keep the appended arrays short, however many elements there are."""
    none = F.array().cast("array<int>")

    def added(sums: Column, value: Column) -> Column:
        return F.array_append(sums, join(F.coalesce(F.get(sums, F.size(sums) - 1), F.lit(0)), value))

    def blocks(array: Column) -> Column:
        starts = F.sequence(F.lit(0), F.floor((F.size(array) - 1) / BLOCK).cast("int"))
        return F.transform(starts, lambda block: F.aggregate(F.slice(array, block * BLOCK + 1, BLOCK), none, added))

    def moved(inner: Column) -> Column:
        shifts = F.aggregate(inner, F.array(F.lit(0)), lambda sums, block: added(sums, F.get(block, F.size(block) - 1)))
        return bind(shifts, lambda known: F.flatten(F.transform(inner, lambda block, number: bind(
            F.get(known, number), lambda shift: F.transform(block, lambda value: join(shift, value))))))

    return bind(values, lambda array: F.when(F.size(array) > 0, bind(blocks(array), moved)).otherwise(none))


def running_sums(values: Column) -> Column:
    return running(values, lambda one, other: one + other)


def running_greatest(values: Column) -> Column:
    return running(values, F.greatest)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def part(place: Column) -> Column:
        digit = F.substring(number, F.length(number) - place + 1, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(place % 2 == 1, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(number)), part), F.lit(0), lambda total, value: total + value) % 10 == 0


def valid(kind: str, hit: Column) -> Column:
    """What a base match must fulfil besides its pattern; failing matches are dropped, not searched again."""
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda part: F.regexp_replace(part, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return F.when(F.length(digits(hit)).between(14, 19), luhn(digits(hit))).otherwise(False)
    if kind == "phone":
        return F.length(digits(hit)).between(10, 15)
    return F.lit(True)


def _votes(kind: str, base: bool, hit: Column, before: Column, after: Column) -> tuple[Column, Column, Column]:
    """The votes (1 personal, -1 not, 0 none) of the regex, gazetteer and context labelers."""
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    if kind == "email":
        ending = F.lower(F.substring_index(hit, ".", -1))
        shape, known = (yes if base else none), F.when(ending.isin(ENDINGS), yes).otherwise(no)
    elif kind == "ip":
        shape, known = yes, F.when(hit.rlike(r"^0*(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])\."), yes).otherwise(no)
    elif kind == "card":
        shape, known = yes, F.when(hit.rlike("^[3-6]"), yes).otherwise(no)
    elif kind == "phone":
        shape = yes if base else F.when(hit.rlike(r"^\([0-9]{3}\)\x20[0-9]{3}-"), yes).otherwise(none)
        known = F.when(hit.rlike(COUNTRY_CODES if base else r"^\(?[2-9]"), yes).otherwise(no)
    elif kind == "secret":
        value = F.regexp_extract(hit, r"[=:]\x20?(.*)$", 1)
        shape = F.when(value.rlike("[0-9]") & value.rlike("[A-Za-z]"), yes).otherwise(no)
        known = F.when(value.rlike(PLACEHOLDERS), no).otherwise(yes)
    else:
        shape, known = none, yes
    context = F.when(before.rlike(rf"(?i)(?:{COUNTER_CUES})\W{{0,3}}$") | after.rlike("^[A-Za-z0-9_]"), no).when(
        before.rlike(rf"(?i)\b(?:{CUES[kind]})\w{{0,8}}\W{{0,4}}(?:\w{{1,8}}\W{{1,3}})?$"), yes).otherwise(none)
    return shape, known, context


def _found(kind: str, base: bool, hits: Column, gaps: Column) -> Column:
    """Candidates of one pattern: start, kind number, stop, base, votes and features. ``gaps`` are the pieces between the hits."""
    stops = running_sums(F.transform(hits, lambda hit, number: F.length(hit) + F.length(F.get(gaps, number))))
    number_of = KINDS.index(kind)

    def build(step: Column) -> Column:
        hit, before, after = step["hit"], step["before"], step["after"]
        shape, known, context = _votes(kind, base, hit, before, after)
        edge = F.when(before == "", "start").when(before.rlike(r"\s$"), "space").when(before.rlike(r"\w$"), "word").otherwise("mark")
        return F.struct(
            (step["stop"] - F.length(hit)).alias("start"), F.lit(number_of).alias("kind"), step["stop"].alias("stop"), F.lit(base).alias("base"),
            F.concat_ws(",", *(vote.cast("string") for vote in (shape, known, context))).alias("votes"),
            F.concat_ws(",", edge, F.least(F.floor(F.length(hit) / 4), F.lit(12)).cast("string")).alias("traits"))

    steps = bind(stops, lambda sums: F.transform(hits, lambda hit, number: F.struct(
        hit.alias("hit"), F.get(sums, number).alias("stop"), F.right(F.get(gaps, number), F.lit(CONTEXT_CHARS)).alias("before"),
        F.left(F.get(gaps, number + 1), F.lit(2)).alias("after"))))
    checked = F.filter(steps, lambda step: valid(kind, step["hit"])) if base else steps
    return F.transform(checked, build)


def with_candidates(documents: DataFrame, text: str = "text") -> DataFrame:
    """Add ``candidates``: base spans and proposals, each evaluated once, sorted by start and kind."""
    patterns = [(kind, True, BASE[kind]) for kind in BASE_KINDS] + [(kind, False, pattern) for kind, pattern in LOOSE.items()]
    whole = F.coalesce(F.col(text), F.lit(""))
    guards = {("email", True): F.contains(whole, F.lit("@")), ("phone", True): F.contains(whole, F.lit("+")),
              ("email", False): whole.rlike(r"(?i)[\[(]\x20?at\x20?[\])]")}
    none = F.array().cast("array<string>")
    hits = {f"hits_{number}": F.when(guards.get((kind, base), F.lit(True)), F.regexp_extract_all(whole, F.lit(pattern), F.lit(0))).otherwise(none)
            for number, (kind, base, pattern) in enumerate(patterns)}
    rows = pin(documents, **hits)
    gaps = {f"gaps_{number}": F.when(F.size(f"hits_{number}") > 0, F.split(whole, pattern, -1)).otherwise(none)
            for number, (_, _, pattern) in enumerate(patterns)}
    rows = pin(rows, **gaps)
    arrays = [_found(kind, base, F.col(f"hits_{number}"), F.col(f"gaps_{number}")) for number, (kind, base, _) in enumerate(patterns)]
    rows = pin(rows, merged=F.array_sort(F.concat(*arrays)))
    # In the order of starts, a proposal meets a base span if one before it ends behind its start, or the next one starts before its end.
    reached = running_greatest(F.transform("merged", lambda one: F.when(one["base"], one["stop"]).otherwise(0)))
    ahead = F.reverse(running_greatest(F.reverse(F.transform("merged", lambda one: F.when(one["base"], FAR - one["start"]).otherwise(0)))))
    rows = pin(rows, reached=reached, ahead=ahead)
    apart = F.filter("merged", lambda one, number: one["base"] | (
        (F.get(F.col("reached"), number) <= one["start"]) & (FAR - F.get(F.col("ahead"), number) >= one["stop"])))
    return pin(rows, candidates=apart).drop("merged", "reached", "ahead", *hits, *gaps)


def _normal(values: list[float]) -> list[float]:
    total = sum(values)
    return [value / total for value in values]


def reliabilities(counts: dict[tuple[int, str], int], rounds: int = 30) -> dict[tuple[int, str], float]:
    """Expectation-maximisation per kind over counted votes: the probability that a candidate with these votes is personal data.

    Every labeler has, for personal and other candidates, a distribution over its votes; one half of a candidate is added to each cell.
    The start is the share of positive votes, so a positive vote keeps its meaning.
    """
    out: dict[tuple[int, str], float] = {}
    for kind in {kind for kind, _ in counts}:
        rows = [([int(vote) for vote in votes.split(",")], count, votes) for (own, votes), count in counts.items() if own == kind]
        sure = [(1 + sum(vote > 0 for vote in votes)) / (2 + sum(vote != 0 for vote in votes)) for votes, _, _ in rows]
        for _ in range(rounds):
            prior = _normal([sum(count * (1 - p) for (_, count, _), p in zip(rows, sure, strict=True)) + 1,
                             sum(count * p for (_, count, _), p in zip(rows, sure, strict=True)) + 1])
            tables = []
            for labeler in range(len(rows[0][0])):
                cells = [[0.5] * 3, [0.5] * 3]
                for (votes, count, _), p in zip(rows, sure, strict=True):
                    cells[0][votes[labeler] + 1] += count * (1 - p)
                    cells[1][votes[labeler] + 1] += count * p
                tables.append([_normal(row) for row in cells])
            sure = []
            for votes, _, _ in rows:
                odds = math.log(prior[1] / prior[0]) + sum(
                    math.log(table[1][vote + 1] / table[0][vote + 1]) for table, vote in zip(tables, votes, strict=True))
                sure.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        out.update({(kind, votes): p for (_, _, votes), p in zip(rows, sure, strict=True)})
    return out


def _features(kind: int, votes: str, traits: str) -> list[str]:
    edge, length = traits.split(",")
    return [f"{kind}", *(f"{kind}:v{number}:{vote}" for number, vote in enumerate(votes.split(","))), f"{kind}:e:{edge}", f"{kind}:l:{length}"]


def train(rows: list[tuple[int, str, str, int]], rounds: int = 200, rate: float = 0.3, decay: float = 0.01) -> dict[str, float]:
    """Logistic span classifier on (kind, votes, traits, count), aimed at the probabilities of the reliabilities."""
    counts: dict[tuple[int, str], int] = defaultdict(int)
    for kind, votes, _, count in rows:
        counts[kind, votes] += count
    goals = reliabilities(counts)
    weights: dict[str, float] = defaultdict(float)
    squares: dict[str, float] = defaultdict(lambda: 1e-8)
    sizes: dict[int, int] = defaultdict(int)
    for kind, _, _, count in rows:
        sizes[kind] += count
    listed = [(_features(kind, votes, traits), goals[kind, votes], count / sizes[kind]) for kind, votes, traits, count in rows]
    for _ in range(rounds):
        slopes: dict[str, float] = defaultdict(float)
        for names, goal, share in listed:
            odds = sum(weights[name] for name in names)
            error = (1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) - goal) * share
            for name in names:
                slopes[name] += error
        for name, slope in slopes.items():
            slope += decay * weights[name] / 100
            squares[name] += slope * slope
            weights[name] -= rate * slope / math.sqrt(squares[name])
    return dict(weights)


def fit(candidates: DataFrame) -> dict[str, float]:
    """Train on the votes and traits of all candidates of all documents. The driver gets counts of at most 27 * 4 * 13 rows a kind."""
    one = candidates.select(F.inline("candidates"))
    rows = one.groupBy("kind", "votes", "traits").agg(F.count("*").alias("n")).orderBy("kind", "votes", "traits").collect()
    return train([(row.kind, row.votes, row.traits, row.n) for row in rows])


def accepted(candidates: Column, weights: dict[str, float]) -> Column:
    """Base spans, and the candidates whose classifier odds are positive."""
    table = F.create_map(*[F.lit(value) for item in (weights or {"": 0.0}).items() for value in item])

    def keep(one: Column) -> Column:
        kind, votes, traits = one["kind"].cast("string"), F.split(one["votes"], ","), F.split(one["traits"], ",")
        names = [kind, *(F.concat_ws(":", kind, F.lit(f"v{number}"), F.get(votes, F.lit(number))) for number in range(3)),
                 F.concat_ws(":", kind, F.lit("e"), F.get(traits, F.lit(0))), F.concat_ws(":", kind, F.lit("l"), F.get(traits, F.lit(1)))]
        odds = reduce(lambda left, right: left + right, (F.coalesce(F.element_at(table, name), F.lit(0.0)) for name in names))
        return one["base"] | (odds >= 0)

    return F.filter(candidates, keep)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda one: F.concat_ws(":", F.get(names, one["kind"]), one["start"].cast("string"), one["stop"].cast("string"))), ",")


def find(documents: DataFrame) -> DataFrame:
    """The contract of op6."""
    rows = written(with_candidates(documents.select("doc_id", "text")).select("doc_id", "candidates"), "candidates")
    kept = pin(rows, spans_kept=accepted(F.col("candidates"), fit(rows)))
    base = F.filter("spans_kept", lambda one: one["base"])

    def count(number: int, kind: str) -> Column:
        return F.size(F.filter("spans_kept", lambda one: one["base"] & (one["kind"] == number))).cast("long").alias(f"n_{kind}")

    counts = [count(number, kind) for number, kind in enumerate(BASE_KINDS)]
    return kept.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans_kept")).alias("spans"))


def masked(text: Column, spans: Column, block_characters: int = TEXT_BLOCK) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the later one gives what it has beyond the earlier.

    A long text is put together by blocks: finding a character takes a walk from the beginning of a string, so a cut walks through one block only.
    """
    names = F.array(*[F.lit(f"[{kind.upper()}]") for kind in KINDS])
    size = F.length(text)

    def cuts(reached: Column) -> Column:
        before = F.transform(spans, lambda one, number: F.struct(
            F.coalesce(F.get(reached, number - 1), F.lit(0)).alias("gap"), one["start"].alias("start"), one["stop"].alias("stop"), one["kind"].alias("kind")))
        real = F.transform(F.filter(before, lambda one: one["stop"] > one["gap"]), lambda one: F.struct(
            one["gap"].alias("gap"), F.greatest(one["gap"], one["start"]).alias("start"), one["kind"].alias("kind")))
        rest = F.struct(F.element_at(reached, -1).alias("gap"), size.alias("start"), F.lit(-1).alias("kind"))
        return F.concat(real, F.array(rest))

    def piece(block: Column, low: Column, cut: Column) -> Column:
        high = low + block_characters
        begin = F.greatest(cut["gap"], low)
        kept = F.substring(block, begin - low + 1, F.least(cut["start"], high) - begin)
        here = (cut["kind"] >= 0) & (cut["start"] >= low) & (cut["start"] < high)
        return F.concat(kept, F.when(here, F.get(names, cut["kind"])).otherwise(""))

    def joined(all_cuts: Column) -> Column:
        lows = F.transform(F.sequence(F.lit(0), F.floor(size / block_characters).cast("int")), lambda number: number * block_characters)
        blocks = F.transform(lows, lambda low: bind(F.substring(text, low + 1, F.lit(block_characters)), lambda block: F.array_join(F.transform(
            F.filter(all_cuts, lambda cut: (cut["gap"] < low + block_characters) & (cut["start"] >= low)), lambda cut: piece(block, low, cut)), "")))
        return F.array_join(blocks, "")

    done = bind(running_greatest(F.transform(spans, lambda one: one["stop"])), lambda reached: bind(cuts(reached), joined))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def mask(documents: DataFrame) -> DataFrame:
    """Pipeline stage: spans are replaced in the text, ``n_chars`` (if there) is its new length; all rows and columns stay."""
    own = kept_names(documents.columns)[documents.columns.index("text")]  # the text is carried once
    rows = written(with_candidates(packed(documents, "text").drop(own)), "texts-with-candidates")
    kept = pin(rows, spans_kept=accepted(F.col("candidates"), fit(rows)))
    done = pin(kept, text_masked=masked(F.col("text"), F.col("spans_kept")))
    changed = {"text": F.col("text_masked")}
    if "n_chars" in documents.columns:
        changed["n_chars"] = F.length("text_masked").cast(documents.schema["n_chars"].dataType)
    return unpacked(done, documents.columns, **changed)

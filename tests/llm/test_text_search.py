"""Collocations, decontamination and ranked search against plain loops, and their defined results on odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tasklore.llm import collocations, decontamination, ranked_search

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa".split()
ODD = ["", None, "   ", ".,;", "Ünï CÖDE ünï", "x" * 50_000, "the the the the the the", "a\tb\x0bc d\re f"]


def texts(seed: int, number: int) -> list[str | None]:
    make = random.Random(seed)
    out = [" ".join(make.choice(WORDS[:make.choice((3, 6, 10))]) + make.choice(("", "", "", ",", ".", "\n")) for _ in range(make.randint(0, 40))) for _ in range(number)]
    return [*out, *ODD, *out[:5]]


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(None if number % 17 == 3 else number, text, ("en", "de", None)[number % 5 % 3], "clash", 1) for number, text in enumerate(texts(1, 150))]
    rows += [rows[0], rows[0], (0, "another text of alpha beta gamma", "en", "clash", 2), (None, "no id alpha beta", "en", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, term string, n long").repartition(3)


def all_collocations(rows, least: int, longest: int, top: int):
    counts, sizes = Counter(), Counter()
    for row in rows:
        lang = row.lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda found: found[0].lower(), row.text or "")):
            words = [word for word in re.split("[ \t]", piece) if word]
            sizes[lang] += len(words)
            counts.update((lang, tuple(words[at:at + k])) for k in range(1, longest + 1) for at in range(len(words) - k + 1))
    frequent = {key: n for key, n in counts.items() if n >= least}
    found = []
    for (lang, phrase), a in frequent.items():
        k = len(phrase)
        held = any(other_lang == lang and len(other) > k and b >= a and any(other[at:at + k] == phrase for at in range(len(other) - k + 1))
                   for (other_lang, other), b in frequent.items())
        if k > 1 and not held:
            score, _, left, right = min((1000 * a * sizes[lang] // (counts[lang, phrase[:c]] * counts[lang, phrase[c:]]), c, counts[lang, phrase[:c]], counts[lang, phrase[c:]]) for c in range(1, k))
            found.append((lang, -score, -a, " ".join(phrase).encode(), left, right, sizes[lang]))
    out = []
    for lang in sizes:
        for rank, (_, score, a, phrase, left, right, n) in enumerate(sorted(one for one in found if one[0] == lang)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


@pytest.mark.parametrize(("shards", "bits", "held"), [(3, 1 << 16, 50), (2, 64, 1 << 20)])  # 64 bits let every phrase through
def test_collocations_are_those_of_a_loop(spark, documents, shards, bits, held):
    found = collocations.collocations(documents, 7, 4, 40, shards, bits, held)
    assert sorted(map(tuple, found.collect())) == all_collocations(documents.collect(), 7, 4, 40)


def test_collocations_of_an_empty_table(spark, documents):
    assert collocations.collocations(documents.limit(0)).collect() == []


def words_of(text: str | None) -> list[str]:
    return [word for word in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda found: found[0].lower(), text or "")) if word]


@pytest.fixture(scope="module")
def benchmark(spark, documents):
    some = [row.text for row in documents.collect() if row.text and len(words_of(row.text)) > 14][:6]
    rows = [(number, " ".join(words_of(text)[2:14])) for number, text in enumerate(some)]
    rows += [(10, "alpha"), (11, "Ünï code"), (12, ""), (13, None), (None, "the the the"), (14, "nowhere alpha"), (2, "eta theta"), (10, "alpha"), (15, "the THE the the")]
    return spark.createDataFrame([(*row, "clash") for row in rows], "item_id long, text string, window_id string")


def test_contamination_is_that_of_a_loop(spark, documents, benchmark):
    held = {}
    for row in benchmark.collect():
        words = words_of(row.text)
        for at in range(max(len(words) - 4, 1) if words else 0):
            held.setdefault(tuple(words[at:at + 5]), set()).add("" if row.item_id is None else str(row.item_id))
    expected = []
    for row in documents.collect():
        words, hit, items = words_of(row.text), set(), set()
        for at in range(len(words)):
            for size in range(1, 6):
                if (key := tuple(words[at:at + size])) in held and len(key) == size:
                    hit |= set(range(at, at + size))
                    items |= held[key]
        expected.append((row.doc_id, len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    found = decontamination.contamination(documents, benchmark, 5).collect()
    assert Counter(map(tuple, found)) == Counter(expected) and sum(row.contaminated for row in found) > 20
    assert decontamination.contamination(documents.limit(0), benchmark).collect() == []
    assert not any(row.contaminated for row in decontamination.contamination(documents, benchmark.limit(0)).collect())


def test_proximity_is_that_of_a_loop(spark, documents, benchmark):
    found, _ = decontamination.windows(benchmark, 3)
    index = decontamination.postings(documents, found.selectExpr("explode(words) as term").distinct())
    got = {(tuple(row.words), row.text_hash, row.begin) for row in decontamination.proximity_matches(index, found, 6).join(found, "window_id").collect()}
    keys = {row.text: row.text_hash for row in decontamination._named(documents).collect()}
    expected = set()
    for row in documents.select("text").distinct().collect():
        words = words_of(row.text)
        for window in {tuple(one.words) for one in found.collect()}:
            expected |= {(window, keys[row.text], at) for at in range(len(words)) if set(window) <= set(words[at:at + 6])}
    assert got == expected and got


def searched(documents, items, top: int):
    def terms(text):
        return re.findall("[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda found: found[0].lower(), text or ""))

    rows = [(row.doc_id, Counter(terms(row.text))) for row in documents if terms(row.text)]
    total, n = sum(sum(counts.values()) for _, counts in rows), len(rows)
    holders = Counter(term for _, counts in rows for term in counts)
    asked = {}
    for item, text in {(row.item_id, row.text or "") for row in items}:
        asked.setdefault((item, text if item is None else ""), Counter()).update(terms(text))
    out = []
    for (item, _), query in asked.items():
        scores = []
        for doc_id, counts in rows:
            m = 25 + 75 * sum(counts.values()) * n // total
            score = sum(repeats * math.floor(1000 * math.log((2 * n + 2) / (2 * holders[term] + 1))) * (10**9 * counts[term] // (1000 * counts[term] + 8 * m))
                        for term, repeats in query.items() if term in counts)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item, rank, doc_id, -score) for rank, (score, _, doc_id) in enumerate(sorted(scores)[:top], 1)]
    return Counter(out)


@pytest.mark.parametrize("shard", [7, 16_384])
def test_ranked_search_is_that_of_a_loop(spark, documents, benchmark, shard):
    found = ranked_search.ranked(documents, benchmark, top=4, block_items=5, shard_texts=shard)
    assert Counter(map(tuple, found.collect())) == searched(documents.collect(), benchmark.collect(), 4)


@pytest.mark.parametrize(("opened", "short"), [(1, 0), (1, 1), (5, 3), (400, 16)])
def test_ranges_are_opened_until_the_result_is_certain(opened, short):
    make = np.random.default_rng(opened)
    sizes = make.integers(0, 6, 300)
    terms = np.concatenate([np.sort(make.choice(12, size, False)) for size in sizes])
    lengths = sizes + make.integers(1, 9, 300)
    weights = make.integers(0, 4, 12)  # few values, many ties
    shard = ranked_search.Shard(make.permutation(300), lengths, sizes, terms, make.integers(1, 3, len(terms)), weights, 300, int(lengths.sum()))
    for _ in range(20):
        asked, repeats = np.unique(make.choice(12, make.integers(1, 8)), return_counts=True)
        all_scores = np.zeros(300, np.int64)
        for term, times in zip(asked, repeats, strict=True):
            own = shard.keys // 301 == term
            np.add.at(all_scores, shard.text[own], shard.impact[own] * times)
        some = all_scores > 0
        expected = ranked_search.better(all_scores[some], shard.ids[some], 10)
        none = np.zeros(0, np.int64)
        found = ranked_search.search(shard, asked, repeats, 10, none, none, opened, short)
        assert [one.tolist() for one in found] == [one.tolist() for one in expected]


def test_ranked_search_of_copies_takes_the_smallest_ids(spark):
    rows = [(number, "alpha beta" if number % 2 else "alpha beta gamma") for number in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = ranked_search.ranked(documents, spark.createDataFrame([("q", "gamma")], "item_id string, text string")).orderBy("rank").collect()
    assert [(row.item_id, row.rank, row.doc_id) for row in found] == [("q", rank + 1, 2 * rank) for rank in range(10)]


def test_ranked_search_takes_empty_tables(spark, documents, benchmark):
    assert ranked_search.ranked(documents.limit(0), benchmark).collect() == []
    assert ranked_search.ranked(documents, benchmark.limit(0)).collect() == []
    assert ranked_search.ranked(documents, benchmark.filter("item_id = 12")).collect() == []

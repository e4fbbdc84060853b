"""The operators against brute force, round trips and held-out accuracy on the given tables."""

import hashlib
import random
import re
import time
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tasklore.llm import embedding_dedup, language_id, licenses, mixing, packing, pii, simhash, topk, toxicity
from tasklore.llm.common import smallest_hashes, table
from tasklore.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {row.doc_id: row.text for row in table(spark, FOLDER, "documents", "doc_id", "text").collect()}


@pytest.mark.parametrize("name", ORACLES)
def test_oracles(spark, name):
    con = duckdb.connect()
    for source in ("embeddings", "pages", "documents", "benchmark"):
        con.execute(f"CREATE VIEW {source} AS SELECT * FROM read_parquet('{FOLDER}/{source}.parquet')")
    frame = QUERIES[name](spark, FOLDER)
    wanted = con.execute(f"SELECT {', '.join(frame.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, frame.collect()))) == sorted(map(str, wanted))


def test_top_k_reads_in_bound_order_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    small = topk.top_k(table(spark, FOLDER, "embeddings", "vec_id", "embedding")).collect()
    monkeypatch.undo()
    assert sorted(small) == sorted(topk.top_k(table(spark, FOLDER, "embeddings", "vec_id", "embedding")).collect())


def test_held_out_toxicity_and_language(spark):
    labels = table(spark, FOLDER, "labels", "doc_id", "toxic")
    rows = toxicity.toxicity_query(table(spark, FOLDER, "documents", "doc_id", "text"), labels).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([row.predicted == row.toxic for row in rows]) >= 0.97
    documents = table(spark, FOLDER, "documents", "doc_id", "text", "lang")
    found = language_id.language_query(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([row.lang == row.lang_pred for row in found if row.held_out]) >= 0.97
    assert sum(row.rejected for row in found) <= 0.005 * len(found)


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[at:at + 3]) for at in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    values = [xxhash.xxh64_intdigest(shingle, seed=42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(value >> bit & 1 for value in values) > len(values))


@pytest.mark.parametrize("tile_rows", [4096, 2])
def test_simhash_against_all_pairs(spark, texts, tile_rows, monkeypatch):
    monkeypatch.setattr(simhash.tiles, "__defaults__", (tile_rows,))
    monkeypatch.setattr(simhash.links, "__defaults__", (3, tile_rows))
    chosen = dict(sorted(texts.items())[:250])
    chosen |= {10_000 + key: text + " tail" for key, text in list(chosen.items())[:30]} | {20_000: None, 20_001: " ", 20_002: "One Two", 20_003: "one  two"}
    frame = spark.createDataFrame(list(chosen.items()), "doc_id long, text string")
    prints = {key: brute_fingerprint(text) for key, text in chosen.items()}
    parent = {key: key for key in prints}

    def root(key):
        while parent[key] != key:
            key = parent[key]
        return key

    for left in prints:
        for right in prints:
            if left < right and (prints[left] ^ prints[right]).bit_count() <= 3:
                first, second = root(left), root(right)
                parent[max(first, second)] = min(first, second)
    found = {row.doc_id: (row.fingerprint, row.component_id) for row in simhash.near_duplicates(frame).collect()}
    assert found == {key: (f"{prints[key]:016x}", root(key)) for key in prints}


@pytest.mark.parametrize("tile_rows", [1024, 4])
def test_embedding_links_against_all_pairs(spark, tile_rows):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 64))
    vectors = np.concatenate([centres + rng.normal(size=(12, 64)) * scale for scale in (0.0, 0.02, 0.05, 0.08, 0.1, 0.0)] * 3).astype(np.float32)
    rows = [(number, vector.tolist(), number % 2) for number, vector in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    unit = vectors.astype(float) / np.linalg.norm(vectors.astype(float), axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (np.arange(len(rows))[:, None] % 2 == np.arange(len(rows)) % 2) & ~np.eye(len(rows), dtype=bool)
    found = np.array([row.n_links for row in embedding_dedup.near_duplicates(frame, tile_rows=tile_rows).orderBy("vec_id").collect()])
    assert (found <= near.sum(axis=1)).all() and found.sum() >= 0.95 * near.sum()


def test_spans_are_masked_and_kept_apart_like_in_a_loop(spark):
    make = random.Random(8)
    pool = ["10.0.0.1", "555-123-4567", "(212) 555-0199", "+49 30 1234567", "a.b@c.de", "me [at] home.org", "4111 1111 1111 1111", "token=ab12cd34ef", "Mr Smith", "é", "und", "10.0.0.1.555-123-4567", "password: a@b.com99"]
    texts = ["".join(make.choice(pool) + make.choice((" ", "", ", ", "\n")) for _ in range(make.randint(0, 25))) for _ in range(150)]
    rows = pii.with_candidates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    spans = F.filter("candidates", lambda one: F.lit(True))
    found = rows.select("text", "candidates", *[pii.masked(F.col("text"), spans, size).alias(f"masked_{size}") for size in (1, 7, 64, 32_768)]).collect()
    loose = 0
    for row in found:
        strict = [one for one in row.candidates if one.base]
        loose += len(row.candidates) - len(strict)
        assert not any(one.start < other.stop and other.start < one.stop for one in row.candidates if not one.base for other in strict)
        out, last = [], 0
        for one in row.candidates:
            if one.stop > last:
                out.append(row.text[last:max(last, one.start)] + f"[{pii.KINDS[one.kind].upper()}]")
                last = one.stop
        assert {row.masked_1, row.masked_7, row.masked_64, row.masked_32768} == {"".join(out) + row.text[last:]}
    assert loose > 50


def test_a_text_full_of_personal_data_takes_linear_time(spark):
    text = "".join(f"10.0.{number % 250}.7 or 555-123-{1000 + number % 9000} é " for number in range(6000))
    frame = spark.createDataFrame([(1, text)], "doc_id long, text string")
    start = time.time()
    masked = pii.mask(frame).first().text
    assert masked.count("[IP]") == 6000 and len(masked) < len(text) and time.time() - start < 30


def test_token_ids_are_those_of_the_tokenizer():
    ids = packing.DocumentIds(public_tokenizers.path("byte_bpe_50k.json"))
    make = random.Random(3)
    alphabet = ["a", "Bcd", "élan", "ß", "don't", "WE'LL", "12", "3.5", ".", ",", "!?", "...", "_", "a_b", "-", "ª", "º", "²", "日", "\t", "\n", "\r\n", " ", "  ", "\u00a0", "(x)", "x;", "Ñ!", "<|endoftext|>"]
    for _ in range(4000):
        text = "".join(make.choice(alphabet) + make.choice(("", " ", " ", "\n")) for _ in range(make.randint(1, 12)))
        expected = [*ids.tokenizer.encode(text, add_special_tokens=False).ids, 0]
        assert np.frombuffer(ids.of(text), "<u4").tolist() == expected, text


def test_rows_that_share_an_id_are_judged_by_their_text(spark):
    """One row of each component stays: the first by (id, fingerprint), no text is lost and none stays twice."""
    make = random.Random(5)
    base = [" ".join(make.choice(["red", "blue", "green", "oak", "elm", "sky"]) + str(make.randint(0, 99)) for _ in range(30)) for _ in range(9)]
    rows = [(3, base[0], "a"), (7, base[0], "b"), (7, base[1], "c"), (7, base[1], "d"), (7, base[1], "c"), (None, base[2], "e"), (None, base[2], "f"),
            (None, base[1], "g"), (9, base[2] + " ", "h"), (None, base[3], "i"), (None, base[3], "j"), (12, None, "k"), (12, "", "l"), (5, base[4], "m"), (5, base[5], "n"), (4, base[5], "o"), (8, base[6], "p")]
    results = []
    for parts in (1, 5):
        frame = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").repartition(parts)
        results.append(sorted(map(tuple, simhash.keep_one_of_each(frame).collect()), key=str))
    assert results[0] == results[1]
    prints = {text: brute_fingerprint(text) for _, text, _ in rows}
    assert min((one ^ other).bit_count() for one in prints.values() for other in prints.values() if one != other) > 3
    groups = {}
    for row in rows:
        groups.setdefault(prints[row[1]], []).append(row)
    assert len(results[0]) == len(groups)
    for row in results[0]:
        members = groups[prints[row[1]]]
        assert row in members and row[0] == min((member[0] for member in members if member[0] is not None), default=None)


def test_packing_round_trip(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    chosen = dict(list(texts.items())[:80]) | {9_001: "a \n\n  b  c\t日本 ² it's", 9_002: "<|endoftext|>", 9_003: "x" * 9000}
    rows = packing.pack_bpe(spark.createDataFrame(list(chosen.items()), "doc_id long, text string")).collect()
    for key, text in chosen.items():
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 0]
        own = sorted((row for row in rows if row.doc_id == key), key=lambda row: row.piece)
        assert sum(row.length for row in own) == len(ids) and all(row.length == 2048 for row in own[1:])
        assert all(zlib.crc32(np.array(ids[row.start:row.start + row.length], "<u4").tobytes()) == row.ids_crc32 for row in own)
    ends = {}
    for row in sorted(rows, key=lambda row: (row.sequence_id, row.offset)):
        assert row.offset == ends.get(row.sequence_id, 0)
        ends[row.sequence_id] = row.offset + row.length
    assert max(ends.values()) <= 2048


def test_plan_is_best_fit_decreasing():
    for seed in range(60):
        rng = random.Random(seed)
        limit = rng.choice([7, 16, 50])
        lengths = [rng.randint(1, limit) for _ in range(rng.randint(0, 200))]
        room = []
        for length in sorted(lengths, reverse=True):
            fits = [number for number, left in enumerate(room) if left >= length]
            if fits:
                room[min(fits, key=lambda number: room[number])] -= length
            else:
                room.append(limit - length)
        runs = packing.plan({length: lengths.count(length) for length in set(lengths)}, limit)
        used = {run.sequence + rank // run.each for run in runs for rank in range(run.last - run.first)}
        assert sum(run.last - run.first for run in runs) == len(lengths) and len(used) == len(room)


PLAIN = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    found = []
    for number, (kind, pattern) in enumerate(PLAIN):
        for match in re.finditer(pattern, text or ""):
            digits = [int(digit) for digit in re.findall("[0-9]", match[0])]
            doubled = sum(digit if place % 2 == 0 else 2 * digit - 9 * (digit > 4) for place, digit in enumerate(reversed(digits)))
            good = {"email": True, "ip": kind != "ip" or all(int(part) < 256 for part in match[0].split(".")),
                    "card": 14 <= len(digits) <= 19 and doubled % 10 == 0, "phone": 10 <= len(digits) <= 15}
            if good[kind]:
                found.append((match.start(), number, match.end()))
    return ",".join(f"{PLAIN[number][0]}:{start}:{end}" for start, number, end in sorted(found))


def test_pii_base_spans(spark, texts):
    hard = ["a@b.c_d@e.f a@b.c._x@d.e x@y @z.com", "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.01", "4111 1111-1111 1111 4111111111111111 411111111111111122222",
            "é𝕏 a@b.co 😀 9.9.9.9 +44 20 7946 0958!", "x" * 50_000 + "@b.c", "1." * 5000, "a@b.c " * 1500, "+" * 2000, None]
    chosen = dict(texts) | {90_000 + number: text for number, text in enumerate(hard)}
    rows = pii.find(spark.createDataFrame(list(chosen.items()), "doc_id long, text string")).collect()
    for row in rows:
        base = plain_spans(chosen[row.doc_id])
        assert hashlib.sha256(base.encode()).hexdigest() == row.base_sha256
        assert set(base.split(",")) - {""} <= set(row.spans.split(","))
        assert row.n_email == base.count("email:") and row.n_card == base.count("card:")


def test_pii_mask(spark):
    frame = spark.createDataFrame([(1, "mail é𝕏 a@b.co, +44 20 7946 0958!", 5), (2, "nothing", 7), (3, None, None)], "doc_id long, text string, n_chars long")
    assert [tuple(row) for row in pii.mask(frame).orderBy("doc_id").collect()] == [(1, "mail é𝕏 [EMAIL], [PHONE]!", 25), (2, "nothing", 7), (3, None, None)]


def test_mixture_targets(spark):
    rows = [(number, "w " * (number % 9 + 1), f"s{number % 4}" if number % 5 else None) for number in range(4000)]
    frame = spark.createDataFrame([*rows, (5000, None, "empty")], "doc_id long, text string, source string")
    found = mixing.mixture(frame).join(frame.select("doc_id", "source"), "doc_id").toPandas()
    sums = {str(source): (own["size"].sum(), own.target.iloc[0], own.taken.sum()) for source, own in found.groupby(found.source.fillna("~"))}
    names = sorted(name for name in sums)
    weights = {name: (5, 2, 1)[number % 3] for number, name in enumerate(names)}
    left, shares = 1.5 * sum(size for size, _, _ in sums.values()), {}
    open_names = set(names)
    while True:
        even = {name: left * weights[name] / sum(weights[other] for other in open_names) for name in open_names}
        full = {name for name in open_names if even[name] >= 2 * sums[name][0]}
        if not full:
            break
        shares |= {name: 2 * sums[name][0] for name in full}
        left -= sum(2 * sums[name][0] for name in full)
        open_names -= full
    shares |= even
    for name, (_, target, taken) in sums.items():
        assert target == pytest.approx(shares[name]) and taken == pytest.approx(target, rel=0.08)
    assert (found.taken <= 2 * found["size"]).all() and (found.taken % found["size"].clip(lower=1) == 0).all()


def test_license_lines(spark, texts):
    lines = {"Apache": "Licensed under the Apache License, Version 2.0", "GPL": "GNU General Public License, version 3", "MIT": "Released under the MIT License",
             "CC-BY-NC": "Licensed under CC BY-NC 4.0"}
    found = licenses.license_query(table(spark, FOLDER, "documents", "doc_id", "text")).collect()
    for row in found:
        assert set(row.licenses.split(",")) - {""} == {family for family, line in lines.items() if line in texts[row.doc_id]}


def test_pipeline(spark, texts):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = corpus_pipeline.identify_language(spark, documents, FOLDER)
    assert kept.count() >= 0.99 * documents.count()
    groups = {row.doc_id: row.component_id for row in simhash.near_duplicates(documents).collect()}
    unique = {row.doc_id for row in corpus_pipeline.drop_near_duplicates(spark, documents, FOLDER).collect()}
    assert unique == set(groups.values())
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert {row.doc_id for row in rows} <= unique and sum(row.length for row in rows) > 0


def test_smallest_hashes_equal_a_plain_ranking(spark):
    """A hot label, a small one, repeated keys and a limit by label give what ranking each label as a whole gives."""
    rows = spark.range(4000).select("id", F.when(F.col("id") < 3600, "hot").otherwise("small").alias("kind"))
    rows = rows.union(rows.filter("id % 5 = 0"))
    place = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 40))
    ranks = rows.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(place, "id")))
    for wanted in (F.lit(1), F.lit(300), F.lit(10_000), F.when(F.col("kind") == "hot", 700).otherwise(3)):
        plain = sorted(map(tuple, ranks.filter(F.col("rank") <= wanted).select("id", "kind").collect()))
        assert sorted(map(tuple, smallest_hashes(rows, "kind", wanted, "id").collect())) == plain

"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: no operator fails, and results are as documented."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tasklore.llm import embedding_dedup, language_id, licenses, mixing, packing, pii, simhash, topk, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, copies int, candidates string, dropped_id long"
TEXTS = ["the cat and the dog run over the hill " * 3, "der hund und die katze laufen ueber den berg " * 3, "", None, "12 34 !!", "word " * 60_000, "é" * 10]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(number, text, "en" if number % 2 else "de", f"s{number % 3}" if number % 4 else None, 1, "x", 2, "y", number) for number, text in enumerate(TEXTS * 3)]
    rows += [rows[0], rows[0], (None, "no id here", None, None, None, None, None, None, None), (None, None, "en", "s1", 0, None, 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, rows=((0, 1, 0), (1, 1, 1), (1, 1, 0), (2, 0, None), (None, 1, 1), (7, 0, 0), (8, 0, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


QUERIES = {
    "toxicity": lambda spark, d: toxicity.toxicity_query(d, labels(spark)),
    "packing": lambda spark, d: packing.pack_bpe(d),
    "language": lambda spark, d: language_id.language_query(d),
    "pii": lambda spark, d: pii.find(d),
    "simhash": lambda spark, d: simhash.near_duplicates(d),
    "licenses": lambda spark, d: licenses.license_query(d),
    "mixture": lambda spark, d: mixing.mixture(d),
}


@pytest.mark.parametrize("name", QUERIES)
def test_document_operators_keep_every_row(spark, docs, name):
    found = QUERIES[name](spark, docs)
    assert len(set(found.columns)) == len(found.columns)
    rows = found.collect()
    per_id = docs.groupBy("doc_id").count().collect()
    for row in per_id:
        assert len({(r.doc_id, *(getattr(r, "piece", 0),)) for r in rows if r.doc_id == row.doc_id}) >= 1
    if name != "packing":
        assert len(rows) == docs.count()


@pytest.mark.parametrize("name", QUERIES)
def test_document_operators_take_empty_tables(spark, docs, name):
    assert QUERIES[name](spark, docs.limit(0)).collect() == []


@pytest.mark.parametrize("stage", [stage for name, stage in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_and_take_empty_tables(spark, docs, stage):
    found = stage(spark, docs, "")
    assert found.columns == docs.columns and [kind for _, kind in found.dtypes] == [kind for _, kind in docs.dtypes]
    assert found.count() > 0
    assert stage(spark, docs.limit(0), "").collect() == []


def test_language_defined_results(spark, docs):
    rows = {(row.doc_id, row.lang_pred, row.rejected) for row in language_id.language_query(docs).collect()}
    assert {(2, "und", True), (3, "und", True), (4, "und", True)} <= rows


def test_simhash_stage_keeps_one_row_of_repeated_ids(spark, docs):
    kept = simhash.keep_one_of_each(docs).groupBy("doc_id").count().filter("doc_id is not null and count > 1")
    assert kept.count() == 0


def test_packing_of_null_and_empty_texts_is_the_end_token(spark, docs):
    rows = packing.pack_bpe(docs.filter("doc_id in (2, 3)")).collect()
    assert [row.length for row in rows] == [1, 1] and len({row.sequence_id for row in rows}) == 1


def test_embeddings_without_use(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.001], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [nan, 1.0], 1),
            (7, [inf, 1.0], 1), (8, [None, 1.0], 1), (9, [1.0, 0.0], None), (10, [1.0, 0.0, 0.0], 1), (11, [], 1), (50, [3.0, 0.0], 1), (1, [1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("round", F.lit(1))
    found = {(row.vec_id, row.n_links, row.component_id) for row in embedding_dedup.near_duplicates(frame).collect()}
    assert {(0, 4, 0), (1, 4, 0), (2, 4, 0), (50, 4, 0), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 0, 10), (11, 0, 11)} == found
    best = topk.top_k(frame).filter("query_id = 50").orderBy("rank").collect()
    assert [(row.vec_id, row.score) for row in best][0] == (2, 768 * 512)
    assert {row.vec_id for row in best} == {0, 1, 2, 3}
    assert embedding_dedup.near_duplicates(frame.limit(0)).collect() == topk.top_k(frame.limit(0)).collect() == []


def test_urls(spark):
    urls = [None, "", "no scheme", "http://Example.COM", "http://example.com/en/1?x", "https://www.Example.com/en/", "a://b.net/fr/x", "://net/es/", "x://notnet/es/",
            "x://example.net/de/#a", "x://sub.www.example.com/en/q", "x://é.example.com/en/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = [(row.host, row.path, row.rule, row.verdict) for row in url_filter.judge_pages(frame).orderBy("page_id").collect()]
    assert found[:4] == [("", "", None, "allow")] * 3 + [("example.com", "", None, "allow")]
    assert [row[2:] for row in found[4:]] == [
        ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/fr/", "block"), ("net/es/", "block"), (None, "allow"), (None, "allow"),
        ("www.example.com/en/", "allow"), ("example.com/en/", "block")]
    assert url_filter.judge_pages(frame.limit(0)).collect() == []


def test_host_suffixes_are_those_some_rule_could_have():
    def every(host, path, lengths, labels):
        found, suffix = set(), host
        while suffix:
            if suffix.count(".") + 1 in labels:
                found |= {(len(suffix) + length, len(suffix), suffix + path[:length]) for length in lengths if length <= len(path)}
            suffix = suffix.partition(".")[2]
        return found

    for host in ("", "com", "a.com", "a..com", ".com", "com.", "x.y.z.a.com", "...", "a.b.c.d.e.f.g"):
        for labels in ([1], [2], [1, 3], [2, 5, 9], []):
            assert set(url_filter.candidates(host, "/en/x", [1, 4, 9], labels)) == every(host, "/en/x", [1, 4, 9], labels)
    long = "a." * 500_000 + "example.com"
    assert url_filter.candidates(long, "/", [1], [1, 2]) == [(4, 3, "com/"), (12, 11, "example.com/")]


def test_a_query_id_with_several_vectors_is_asked_with_the_least(spark):
    rows = [(0, [0.5, 0.5]), (0, [-0.5, 0.5]), (0, []), (0, None), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [])]
    for parts in (1, 4):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(parts)
        found = [(row.query_id, row["rank"], row.vec_id, row.score) for row in topk.top_k(frame).orderBy("rank").collect()]
        assert found == [(0, 1, 2, 32768), (0, 2, 1, -32768)]


def test_packing_caches_go_with_their_task():
    import gc
    import weakref

    import public_tokenizers
    from tasklore.llm import packing

    gc.disable()  # a Python worker goes on with other tasks for long before it looks for cycles
    try:
        ids = packing.DocumentIds(public_tokenizers.path("byte_bpe_50k.json"))
        assert len(ids.of("plain words, and words")) > 4
        gone = weakref.ref(ids.words), weakref.ref(ids.chunks)
        del ids
        assert [one() for one in gone] == [None, None]
    finally:
        gc.enable()


def test_token_ids_of_many_texts_are_those_of_each(monkeypatch):
    """Chunks are looked up together; few entries stay, and what has gone is made again. An entry takes far less than two Python objects."""
    import random

    import numpy as np
    import public_tokenizers
    from tasklore.llm import packing

    monkeypatch.setattr(packing, "KNOWN_ENTRIES", 40)
    ids, make = packing.DocumentIds(public_tokenizers.path("byte_bpe_50k.json")), random.Random(7)
    parts = ["a", "Bcd", "élan", "ß", "don't", "12", "3.5", ".", ",", "!?", "_", "²", "日", "\t", "\n", "\r\n", " ", "  ", "(x)", "x;", "Ñ!", "<|endoftext|>"]
    texts = [None, "", " ", "  ", "a", " a", "a ", "\n a", "a\n b", "a \n", "x" * 9000] + [
        "".join(make.choice(parts) + make.choice(("", " ", " ", "\n")) for _ in range(make.randint(1, 12))) for _ in range(600)]
    for start in (0, 11, 300):
        for text, found in zip(texts[start:], ids.of_all(texts[start:]), strict=True):
            assert np.frombuffer(found, "<u4").tolist() == [*ids.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], text
            assert found == ids.of(text)
    assert [text for part in packing.slices(texts, 50) for text in texts[part]] == texts
    assert all(len(texts[part]) == 1 or sum(len(text or "") for text in texts[part]) <= 50 for part in packing.slices(texts, 50))
    monkeypatch.setattr(packing, "KNOWN_ENTRIES", 100_000)
    ids = packing.DocumentIds(public_tokenizers.path("byte_bpe_50k.json"))
    ids.of_all([" ".join("".join(make.choice("abcdefgh") for _ in range(9)) for _ in range(20_000))])
    for known in (ids.words, ids.chunks):
        assert len(known.keys) > 19_000 and known.keys.nbytes + known.ids.nbytes < 70 * len(known.keys)


def test_texts_go_to_python_in_small_batches(spark):
    from tasklore.llm import common, language_id, packing, simhash

    frame = spark.range(5_000).selectExpr("id as doc_id", "concat('some words, ', id) as text", "'en' as lang").coalesce(1)
    before = spark.conf.get(common.BATCH_ROWS)

    def batch_rows(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    try:
        for make in (lambda: packing.pieces(frame, "unused"), lambda: simhash.fingerprints(frame), lambda: language_id.identify(frame, None)):
            spark.conf.set(common.BATCH_ROWS, 10_000)
            make()
            sizes = [row.n for row in frame.mapInArrow(batch_rows, "n long").collect()]
            assert sum(sizes) == 5_000 and max(sizes) <= common.TEXT_ROWS
            spark.conf.set(common.BATCH_ROWS, 10)
            make()
            assert spark.conf.get(common.BATCH_ROWS) == "10"
    finally:
        spark.conf.set(common.BATCH_ROWS, before)

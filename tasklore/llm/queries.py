"""The operators as registered queries over whole tables, and their DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tasklore.llm import (
    collocations,
    decontamination,
    embedding_dedup,
    language_id,
    licenses,
    mixing,
    packing,
    pii,
    ranked_search,
    simhash,
    topk,
    toxicity,
    url_filter,
)
from tasklore.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": lambda spark, d: toxicity.toxicity_query(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "labels", "doc_id", "toxic")),
    "op2_best_fit_packing": lambda spark, d: packing.pack_bpe(table(spark, d, "documents", "doc_id", "text")),
    "op3_embedding_dedup": lambda spark, d: embedding_dedup.near_duplicates(table(spark, d, "embeddings", "vec_id", "embedding", "label")),
    "op4_top_k": lambda spark, d: topk.top_k(table(spark, d, "embeddings", "vec_id", "embedding")),
    "op5_language_id": lambda spark, d: language_id.language_query(table(spark, d, "documents", "doc_id", "text", "lang")),
    "op6_personal_data": lambda spark, d: pii.find(table(spark, d, "documents", "doc_id", "text")),
    "op7_url_rules": lambda spark, d: url_filter.judge_pages(table(spark, d, "pages", "page_id", "url")),
    "op8_simhash": lambda spark, d: simhash.near_duplicates(table(spark, d, "documents", "doc_id", "text")),
    "op9_license_scan": lambda spark, d: licenses.license_query(table(spark, d, "documents", "doc_id", "text")),
    "op10_mixture": lambda spark, d: mixing.mixture(table(spark, d, "documents", "doc_id", "text", "source")),
    "op11_collocations": lambda spark, d: collocations.collocations(table(spark, d, "documents", "text", "lang")),
    "op12_decontamination": lambda spark, d: decontamination.contamination(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text")),
    "op13_ranked_search": lambda spark, d: ranked_search.ranked(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text")),
}

_RULES = ", ".join(f"('{verdict}', '{host}', '{path}')" for verdict, host, path in url_filter.RULES)
_WORD, _TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES: dict[str, str] = {
    "op4_top_k": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM scored
        )
        SELECT query_id, place::INTEGER AS rank, vec_id, score FROM ranked WHERE place <= 5""",
    "op7_url_rules": f"""
        WITH rules(verdict, rule_host, rule_path) AS (VALUES {_RULES}),
        parts AS (
            SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
                   coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
        ), fits AS (
            SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
            FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
        )
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.place = 1""",
    "op11_collocations": f"""
        WITH pieces AS (
          SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM documents
        ), worded AS (
          SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS words FROM pieces
        ), sizes AS (
          SELECT lang, sum(len(words))::BIGINT AS n FROM worded GROUP BY lang
        ), grams AS (
          SELECT lang, k, unnest(list_transform(range(1, len(words) - k + 2), lambda i: words[i:i + k - 1])) AS phrase
          FROM worded, (SELECT unnest(range(1, 6)) AS k) WHERE len(words) >= k
        ), counts AS (
          SELECT lang, k, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100
        ), cuts AS (
          SELECT c.lang, c.phrase, c.k, c.f, s.n, h.f AS l, t.f AS r, ((1000::HUGEINT * c.f * s.n) // (h.f::HUGEINT * t.f))::BIGINT AS score,
                 row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY ((1000::HUGEINT * c.f * s.n) // (h.f::HUGEINT * t.f)), h.k) AS place
          FROM counts c JOIN sizes s ON s.lang = c.lang JOIN counts h ON h.lang = c.lang AND h.k < c.k AND h.phrase = c.phrase[1:h.k]
          JOIN counts t ON t.lang = c.lang AND t.k = c.k - h.k AND t.phrase = c.phrase[h.k + 1:]
        ), held AS (
          SELECT DISTINCT c.lang, c.phrase FROM counts c JOIN counts d ON d.lang = c.lang AND d.k > c.k AND d.f >= c.f
          AND list_contains(list_transform(range(1, d.k - c.k + 2), lambda i: d.phrase[i:i + c.k - 1]), c.phrase)
        ), ranked AS (
          SELECT c.lang, array_to_string(c.phrase, ' ') AS phrase, f AS a, l, r, n, score,
                 row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, f DESC, array_to_string(c.phrase, ' ')) AS rank
          FROM cuts c ANTI JOIN held USING (lang, phrase) WHERE place = 1
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000""",
    "op12_decontamination": f"""
        WITH worded AS (
          SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS words FROM documents
        ), item_words AS (
          SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS words FROM benchmark
        ), item_windows AS (
          SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(words) - 10 + 1, 1) + 1), lambda i: words[i:i + 9])) AS words
          FROM item_words WHERE len(words) > 0
        ), sizes AS (SELECT DISTINCT len(words) AS size FROM item_windows
        ), grams AS (
          SELECT row_no, size, unnest(range(1, len(words) - size + 2)) AS place, unnest(list_transform(range(1, len(words) - size + 2), lambda i: words[i:i + size - 1])) AS gram
          FROM worded, sizes WHERE len(words) >= size
        ), matches AS (
          SELECT row_no, place, size, item FROM grams JOIN item_windows ON grams.gram = item_windows.words
        ), hits AS (
          SELECT row_no, count(DISTINCT hit) AS n_hit FROM (SELECT row_no, unnest(range(place, place + size)) AS hit FROM (SELECT DISTINCT row_no, place, size FROM matches)) GROUP BY row_no
        ), lists AS (
          SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row_no, item FROM matches) GROUP BY row_no
        )
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM worded LEFT JOIN hits USING (row_no) LEFT JOIN lists USING (row_no)""",
    "op13_ranked_search": f"""
        WITH doc_terms AS (
          SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS terms FROM documents
        ), asked AS (
          SELECT item_id, term, count(*)::BIGINT AS repeats
          FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL
        ), sizes AS (
          SELECT count(*)::BIGINT AS texts, sum(len(terms))::BIGINT AS total FROM doc_terms WHERE len(terms) > 0
        ), found AS (
          SELECT row_no, doc_id, len(terms)::BIGINT AS length, unnest(terms) AS term FROM doc_terms
        ), counts AS (
          SELECT row_no, doc_id, length, term, count(*)::BIGINT AS tf FROM found WHERE term IN (SELECT term FROM asked) GROUP BY ALL
        ), weights AS (
          SELECT term, floor(1000 * ln((2 * any_value(texts) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM counts, sizes GROUP BY term
        ), scores AS (
          SELECT item_id, row_no, doc_id, sum(repeats * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * length * texts) // total))))::BIGINT AS score
          FROM asked JOIN counts USING (term) JOIN weights USING (term), sizes GROUP BY ALL
        ), ranked AS (
          SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
        )
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}

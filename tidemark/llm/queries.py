"""Thin queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontamination, exact_dedup, hard_negatives, html_text, katz, language_id, near_dedup, packing, pii, source_audit, substring_dedup, toxicity, url_rules
from tidemark.llm.common import few_files, table

ORACLES: dict[str, str] = {}

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op2_exact_dedup"] = """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rule_table(spark, RULES))


ORACLES["op6_url_rules"] = """
    WITH cut AS (
        SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
    ), parts AS (
        SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
    ), judged AS (
        SELECT *, '.' || host AS dotted, CASE
            WHEN '.' || host LIKE '%.example.com' AND starts_with(path, '/en/7') THEN 'example.com/en/7'
            WHEN '.' || host LIKE '%.example.net' AND starts_with(path, '/de/8') THEN 'example.net/de/8'
            WHEN '.' || host LIKE '%.com' AND starts_with(path, '/en/') THEN 'com/en/'
            WHEN '.' || host LIKE '%.net' AND starts_with(path, '/de/') THEN 'net/de/'
            WHEN '.' || host LIKE '%.org' AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM parts
    )
    SELECT page_id, host, path, rule,
           CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
    FROM judged
"""


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_groups(table(spark, sf_dir, "documents"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.extract(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", "n_chars")


#: A cluster passes its own secret; queries need the same pseudonyms on every run.
PII_KEY = "tidemark-pseudonyms"


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PII_KEY)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return few_files(found.select("doc_id", "item_id", "start", "matched", "windows", "exact"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page; the text model learns from labelled documents, the other evidence is the page's own."""
    model = language_id.fit(table(spark, sf_dir, "documents"))
    return language_id.identify_pages(table(spark, sf_dir, "pages"), model)


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"))


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


ORACLES["op11_source_audit"] = r"""
    WITH docs AS (
        SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
               translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
    ), words AS (
        SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
    ), kept AS (
        SELECT lang, term FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 3
    ), uses AS (
        SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
    ), sides AS (
        SELECT DISTINCT lang, source FROM docs
    ), sizes AS (
        SELECT lang, count(*) AS v FROM kept GROUP BY lang
    ), totals AS (
        SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total FROM sides LEFT JOIN uses USING (lang, source) GROUP BY lang, source
    ), own AS (
        SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n, 1 + 1000000000::HUGEINT * (coalesce(n, 0) + 1) // (total + v) AS p
        FROM kept JOIN totals USING (lang) JOIN sizes USING (lang) LEFT JOIN uses USING (lang, source, term)
    ), whole AS (
        SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q
        FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM own GROUP BY lang, term)
    ), pairs AS (
        SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
        FROM sides a JOIN sides b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN (
            SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
            FROM own x JOIN own y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
        ) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    ), terms AS (
        SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM own JOIN whole USING (lang, term) WHERE n > 0 AND p > q
    ), ranked AS (
        SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
        UNION ALL
        SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
    )
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document; labels are learnt from documents whose crc32(doc_id as text) isn't 1 in threes."""
    found = toxicity.fit_and_score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


ORACLES["op13_hard_negatives"] = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scores AS (
        SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.vec, b.vec)::BIGINT AS score
        FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
    ), positives AS (
        SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
    )
    SELECT anchor_id, positive_id, (row_number() OVER same_pair)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM positives JOIN scores USING (anchor_id)
    WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
    WINDOW same_pair AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
    QUALIFY row_number() OVER same_pair <= 3
"""

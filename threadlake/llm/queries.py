"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, exact_dedup, html_extract, ngram_join, pii, quality, secret_scan, substring_dedup, toxicity
from .common import table

#: The folder of public vocabulary files where their package isn't installed; never copied into this repository.
TOKENIZERS = "/opt/tokenizers"


def word_bpe() -> str:
    """The path of the vocabulary file that the BPE query and stage use."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZERS}/word_bpe_49k.json"
    return public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.links(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), word_bpe())


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_table(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_table(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_table(table(spark, sf_dir, "pages"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_bpe": op3_bpe,
    "op4_decontaminate": op4_decontaminate,
    "op5_secret_scan": op5_secret_scan,
    "op6_pii": op6_pii,
    "op7_quality": op7_quality,
    "op8_html_extract": op8_html_extract,
    "op9_toxicity": op9_toxicity,
    "op10_exact_dedup": op10_exact_dedup,
}

SQL: dict[str, str] = {
    "op1_ngram_join": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 2 THEN ws ELSE [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))] END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 60 * (a.n + b.n - c)),
        r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(k, 0)::BIGINT AS n_similar, least(doc_id, coalesce(m, doc_id)) AS component_id
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, count(*) AS k FROM l GROUP BY x) USING (doc_id)
        LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) USING (doc_id)
    """,
    "op4_decontaminate": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        p AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 7], ' ') AS phrase, least(len(ws), 8) AS n FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
        sizes AS (SELECT DISTINCT n FROM p),
        d AS (SELECT doc_id, n, array_to_string(ws[i:i + n - 1], ' ') AS phrase, i FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes)),
        o AS (SELECT d.doc_id, d.i, d.n, p.item_id FROM d JOIN p ON d.phrase = p.phrase AND d.n = p.n),
        h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM o) GROUP BY doc_id),
        s AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM o) GROUP BY doc_id)
        SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               coalesce(sha, sha256('')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
        FROM w LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
    """,
    "op10_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
}

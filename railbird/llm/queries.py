"""The operators applied to whole tables, one query each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from railbird.llm import decontam, html, jaccard, licenses, media, packing, periodic, pii, quality, simhash, spelling, token_count, warc
from railbird.llm.stage import find_package


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    find_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("mark")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.roundtrip(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report(_table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_warc, op2_pii, op3_html, op4_packing, op5_token_counts, op6_quality, op7_decontamination, op8_simhash, op9_telephony,
        op10_licenses, op11_periodic_runs, op12_spelling, op13_jaccard,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": """
            WITH p AS (
              SELECT page_id, encode(coalesce(html, '')) AS b, sha256(coalesce(html, '')) AS d FROM pages
            ), f AS (
              SELECT d, min(page_id) AS first_id FROM p WHERE octet_length(b) >= 100 GROUP BY d
            )
            SELECT p.page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, p.d AS payload_digest,
                   CASE WHEN f.first_id IS NOT NULL AND f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
            FROM p LEFT JOIN f ON p.d = f.d
        """,
        "op7_decontamination": r"""
            WITH d AS (
              SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
            ), b AS (
              SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
            ), i AS (
              SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[a + 1 : a + 10], ' ') AS said FROM b, unnest(range(greatest(len(w) - 9, 1))) AS t(a) WHERE len(w) > 0
            ), m AS (
              SELECT r, a, x.k, array_to_string(w[a + 1 : a + x.k], ' ') AS said FROM d, (SELECT DISTINCT k FROM i) x, unnest(range(greatest(len(w) - x.k + 1, 0))) AS t(a)
            ), h AS (
              SELECT DISTINCT r, a, m.k, item FROM m JOIN i ON m.said = i.said AND m.k = i.k
            ), n AS (
              SELECT r, count(DISTINCT a + o) AS n_hit FROM h, unnest(range(k)) AS t(o) GROUP BY r
            ), s AS (
              SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
            )
            SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
            FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN s ON s.r = d.r
        """,
        "op13_jaccard": r"""
            WITH RECURSIVE d AS (
              SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
            ), s AS (
              SELECT DISTINCT r, array_to_string(w[a + 1 : a + 3], ' ') AS g FROM d, unnest(range(greatest(len(w) - 2, 1))) AS t(a) WHERE len(w) > 0
            ), n AS (
              SELECT r, count(*) AS n FROM s GROUP BY r
            ), o AS (
              SELECT s.r, n.n, hash(g) AS g FROM s JOIN n ON n.r = s.r
            ), l AS (
              SELECT a.r AS u, b.r AS v FROM o a JOIN o b ON a.g = b.g AND a.r <> b.r AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n
              GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
            ), c AS (
              SELECT r AS u, r AS v FROM d UNION SELECT c.u, l.v FROM c JOIN l ON c.v = l.u
            ), m AS (
              SELECT c.u, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.v GROUP BY c.u
            )
            SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id FROM d LEFT JOIN n ON n.r = d.r JOIN m ON m.u = d.r
        """,
    }

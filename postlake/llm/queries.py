"""The queries of this subpackage, each over its whole table with production parameters, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ctw, exact_dedup, filter_audit, licenses, mixing, periodic, pieces, pii, quality, secrets, simhash, substring_dedup, vector_dedup


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_docs(spark, sf_dir)).drop("found")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_docs(spark, sf_dir))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_copies(_docs(spark, sf_dir))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_docs(spark, sf_dir)).drop("detections")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.round_trip(_docs(spark, sf_dir)))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.label_near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.label_near_copies(_docs(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digests(substring_dedup.remove_repeats(_docs(spark, sf_dir)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(periodic.periodic_runs(periodic.planted(_docs(spark, sf_dir))))


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(_docs(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_personal_data, op3_exact_dedup, op4_license_scan, op5_sentencepiece, op6_embedding_near_dedup, op7_quality_classifier, op8_source_mixing, op9_simhash_near_dedup, op10_substring_dedup, op11_periodic_runs, op12_lm_scoring, op13_filter_audit)}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op10_substring_dedup": r"""
        WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        windows AS (SELECT doc_id, unnest(range(1, len(words) - 48)) AS pos, words FROM texts),
        keyed AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 49], ' ') AS win FROM windows),
        repeats AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY win) AS least FROM keyed) WHERE doc_id > least),
        gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM repeats),
        places AS (SELECT doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM texts),
        stay AS (SELECT p.doc_id, count(*) AS n, string_agg(p.word, ' ' ORDER BY p.pos) AS kept FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.pos = g.pos GROUP BY p.doc_id)
        SELECT t.doc_id, len(t.words)::BIGINT AS n_words, (len(t.words) - coalesce(s.n, 0))::BIGINT AS n_removed, sha256(coalesce(s.kept, '')) AS kept_sha256
        FROM texts t LEFT JOIN stay s USING (doc_id)
    """,
    "op13_filter_audit": r"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        least AS (SELECT text, min(doc_id) AS least FROM docs GROUP BY text),
        failing AS (
            SELECT d.doc_id, d.part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
                   100 * len(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 3 * length(d.text), regexp_matches(d.text, '[#$%&*|]'), coalesce(doc_id > least, least IS NOT NULL)] AS fails
            FROM docs d JOIN least USING (text)),
        told AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        masks AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM failing LEFT JOIN told USING (doc_id) GROUP BY part, fails),
        letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 3), ('D', 4), ('E', 5)) v(letter, k)),
        orders AS (
            SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
        steps AS (SELECT filter_order, step::INT AS step, ks[step] AS k, ks[1:step - 1] AS before FROM orders, range(1, 6) s(step)),
        counts AS (
            SELECT part, filter_order, step, k,
                   sum(CASE WHEN NOT fails[k] AND NOT earlier THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails[k] AND NOT earlier THEN n ELSE 0 END)::BIGINT AS removed,
                   sum(CASE WHEN fails[k] AND earlier THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails[k] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
                   sum(CASE WHEN fails[k] AND NOT earlier THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails[k] AND NOT earlier THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
            FROM (SELECT *, len(list_filter(before, lambda x: fails[x])) > 0 AS earlier FROM masks, steps)
            GROUP BY part, filter_order, step, k)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM counts
    """,
}

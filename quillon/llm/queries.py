"""The queries of the training-data operators over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, line_dedup, mixing, quality, rans, suffixes, toxicity, warc, wrappers
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = line_dedup.deduplicated(table(spark, sf_dir, "documents"), apart=None)
    return d.select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_token_file(spark: SparkSession, sf_dir: str, tokenizer: str = "") -> DataFrame:
    if not tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return rans.tokenised(table(spark, sf_dir, "documents"), tokenizer)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return t.select("doc_id", "held_out", "score", "predicted")


def op6_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality.quality(table(spark, sf_dir, "documents"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_decontaminate, op3_token_file, op4_warc, op5_toxicity, op6_repeated_bytes, op7_main_text, op8_mix_sources, op9_quality_rules, op10_jaccard_join)
}
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE: dict[str, str] = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest FROM p),
        l AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT d.page_id, payload_bytes, d.payload_digest,
            CASE WHEN last IS NULL OR last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN last <> page_id THEN last END AS refers_to
        FROM d LEFT JOIN l USING (payload_digest)""",
    "op2_decontaminate": rf"""
        WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT item_id, list_filter(regexp_split_to_array({_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, 10 AS n, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 9)) AS i FROM b WHERE len(w) >= 10)
            UNION ALL SELECT item_id, len(w), array_to_string(w, ' ') FROM b WHERE len(w) BETWEEN 1 AND 9),
        dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM dw JOIN win USING (n, g)),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY 1),
        its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op10_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 4)
            UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        links AS (SELECT x.doc_id AS u, y.doc_id AS v FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n a ON a.doc_id = x.doc_id JOIN n b ON b.doc_id = y.doc_id
            GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        reach AS (SELECT doc_id AS root, doc_id FROM d UNION SELECT root, v FROM reach JOIN links ON u = reach.doc_id),
        c AS (SELECT doc_id, min(root) AS component_id FROM reach GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)""",
}

"""The queries op1 to op10: each operator over its whole table, with the columns its contract names."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, html_text, licenses, packing, piece_sampling, quality, secret_scan, simhash, token_files, toxicity
from millrace.llm.common import table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, sf_dir, "documents"), radius=2, width=3, seed=42)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), seed=0)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size("secrets").cast("long").alias("n_secrets"),
        F.array_join(F.transform("secrets", lambda s: F.sha2(F.encode(s, "UTF-8"), 256)), ",").alias("secret_sha256"),
        F.sha2(F.encode(F.coalesce("redacted", F.lit("")), "UTF-8"), 256).alias("redacted_sha256"),
    )


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.through_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("matches")
    return licenses.licenses(table(spark, sf_dir, "documents"), threshold=0.8).select(
        "doc_id",
        F.size(m).cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(m["license"])), ",").alias("licenses"),
        F.coalesce(F.array_max(m["dice"]), F.lit(0.0)).alias("best_dice"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    found = docs.select("doc_id", toxicity.score_of(F.col("text"), model).alias("score"))
    return found.select("doc_id", (~toxicity.trainable()).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


OP1_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w),
g3 AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM g),
rep AS (SELECT doc_id, i FROM g3 QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
trimmed AS (
    SELECT doc_id, line, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS t, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
        length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS solid FROM lines),
judged AS (
    SELECT doc_id, line, solid, length(t) > 0 AND (
        (n BETWEEN 4 AND 20 AND NOT contains('ENDINGS', right(t, 1)))
        OR (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))) * 10 > length(t)
        OR (length(t) - length(replace(t, '!', ''))) * 3 > n + 3
        OR (length(t) - length(regexp_replace(t, '[|»›•·]', '', 'g'))) * 4 > n
        OR (regexp_matches(lower(t), 'BOILERPLATE') AND n <= 12)) AS fails
    FROM trimmed),
by_line AS (
    SELECT doc_id, sum(CASE WHEN fails THEN solid ELSE 0 END)::BIGINT AS lost_chars, sum(solid)::BIGINT AS word_chars,
        count(*) FILTER (solid > 0) - count(DISTINCT line) FILTER (solid > 0) AS n_dup_lines FROM judged GROUP BY doc_id),
f AS (
    SELECT w.doc_id, len(w.w)::BIGINT AS n_words, l.word_chars, (length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        l.n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, l.lost_chars
    FROM w JOIN by_line l USING (doc_id) LEFT JOIN covered c USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.3 * word_chars AS kept
FROM f
""".replace("ENDINGS", quality.ENDINGS.replace("'", "''")).replace("BOILERPLATE", "|".join(quality.BOILERPLATE))

OP9_SQL = r"""
WITH t(license, grams, decides) AS (VALUES TEMPLATES),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
split AS (
    SELECT r, unnest(string_split(text, chr(10))) AS passage FROM d
    UNION SELECT r, unnest(regexp_split_to_array(text, '\n[\x20\x09-\x0D]*\n')) AS passage FROM d
    UNION SELECT r, unnest(string_split(regexp_replace(text, '([.!?:;])[\x20\x09-\x0D]+([A-Z(*])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS passage FROM d
    UNION SELECT r, text FROM d),
w AS (SELECT DISTINCT r, passage, string_split(trim(regexp_replace(lower(passage), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM split),
g AS (
    SELECT r, passage, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS g,
        list_sort(list_distinct(list_filter(list_transform(w, lambda x: regexp_replace(x, '^v([0-9])', '\1')), lambda x: regexp_full_match(x, 'DECIDING')))) AS decides FROM w),
dice AS (
    SELECT r, passage, license, round(2 * len(list_intersect(g, grams)) / (len(g) + len(grams)), 6) AS dice FROM g JOIN t
    ON list_has_any(g, grams) AND (t.decides = g.decides)),
best AS (SELECT * FROM dice WHERE dice >= 0.8 QUALIFY row_number() OVER (PARTITION BY r, passage ORDER BY dice DESC, license) = 1),
m AS (SELECT r, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS l, max(dice) AS best FROM best GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(l, '') AS licenses, coalesce(best, 0.0)::DOUBLE AS best_dice FROM d LEFT JOIN m USING (r)
""".replace("TEMPLATES", ", ".join(f"('{name}', {licenses.bigrams_of(text)}, {licenses.deciding_words(text)}::VARCHAR[])" for name, text in licenses.TEMPLATES)).replace("DECIDING", licenses.DECIDING)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_extraction": op3_html_extraction,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_simhash": op5_simhash,
    "op6_piece_sampling": op6_piece_sampling,
    "op7_secret_scan": op7_secret_scan,
    "op8_token_files": op8_token_files,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_dedup": OP1_SQL,
    "op2_quality_rules": OP2_SQL,
    "op9_license_scan": OP9_SQL,
}

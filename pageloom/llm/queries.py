"""The training-data operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from secrets import token_hex

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, licenses, linededup, packing, pii, quality, secrets, sharding, simhash

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_documents(spark, sf_dir))


QUERIES["op2_quality_rules"] = op2_quality_rules


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


QUERIES["op10_simhash_near_dedup"] = op10_simhash_near_dedup


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(_documents(spark, sf_dir))


QUERIES["op4_line_dedup"] = op4_line_dedup
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
ORACLE["op4_line_dedup"] = rf"""
WITH l AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents WHERE text IS NOT NULL
), s AS (
    SELECT doc_id, line_no, list_sort(list_distinct(regexp_extract_all(translate(line, '{_CAPITALS}', '{"".join(chr(ord(c) + 32) for c in _CAPITALS)}'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+'))) AS ws FROM l
), d AS (
    SELECT ws, len(ws) AS n, row_number() OVER () AS id, min((doc_id, line_no)) AS at FROM s WHERE len(ws) > 0 GROUP BY ws
), t AS (SELECT id, n, unnest(ws) AS w FROM d), df AS (SELECT w, count(*) AS c FROM t GROUP BY w
), p AS (SELECT id, w FROM (SELECT id, w, n, row_number() OVER (PARTITION BY id ORDER BY c, w) AS k FROM t JOIN df USING (w)) WHERE k <= n - (4 * n + 4) // 5 + 1
), c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.w = b.w AND a.id < b.id
), later AS (
    SELECT CASE WHEN x.at < y.at THEN y.id ELSE x.id END AS id FROM c JOIN d x ON x.id = c.a JOIN d y ON y.id = c.b
    WHERE 9 * len(list_intersect(x.ws, y.ws)) >= 4 * (x.n + y.n)
)
SELECT s.doc_id, s.line_no FROM s JOIN d ON s.ws = d.ws WHERE d.id IN (SELECT id FROM later) OR (s.doc_id, s.line_no) <> d.at
"""


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES["op9_benchmark_decontamination"] = op9_benchmark_decontamination


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


QUERIES["op6_sharding"] = op6_sharding
ORACLE["op6_sharding"] = """
WITH RECURSIVE grp AS (
    SELECT source, CAST(sum(octet_length(encode(coalesce(text, '')))) AS BIGINT) AS size FROM documents GROUP BY source
), ranked AS (
    SELECT source, size, row_number() OVER (ORDER BY size DESC, source ASC NULLS LAST) AS k FROM grp
), placed(k, loads, shard) AS (
    SELECT CAST(0 AS BIGINT), list_transform(range(16), lambda i: CAST(0 AS BIGINT)), CAST(0 AS BIGINT)
    UNION ALL
    SELECT r.k,
           list_transform(p.loads, lambda x, i: CASE WHEN i = list_position(p.loads, list_min(p.loads)) THEN x + r.size ELSE x END),
           CAST(list_position(p.loads, list_min(p.loads)) - 1 AS BIGINT)
    FROM placed p JOIN ranked r ON r.k = p.k + 1
)
SELECT d.doc_id, d.source AS "group", CAST(p.shard AS INT) AS shard
FROM documents d JOIN ranked r ON d.source IS NOT DISTINCT FROM r.source JOIN placed p ON p.k = r.k
"""


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_documents(spark, sf_dir))


QUERIES["op8_best_fit_packing"] = op8_best_fit_packing


def op1_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under the key in spark.pageloom.pii.key, or else a fresh one that nobody keeps."""
    key = spark.conf.get("spark.pageloom.pii.key", "") or token_hex(32)
    return pii.pseudonymise(_documents(spark, sf_dir), key.encode())


QUERIES["op1_pii_pseudonyms"] = op1_pii_pseudonyms


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES["op3_chat_formatting"] = op3_chat_formatting
ORACLE["op3_chat_formatting"] = """
WITH RECURSIVE m AS (
    SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
    WHERE conv_id IS NOT NULL AND turn IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY coalesce(role, 'unknown'), coalesce(text, '')) = 1
), n AS (
    SELECT *, CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS score,
           (SELECT max(p.turn) FROM m p WHERE p.conv_id = m.conv_id AND p.turn < m.turn AND p.role <> m.role) AS parent
    FROM m
), walk AS (
    SELECT conv_id, turn, CAST(score AS BIGINT) AS score, CAST(1 AS BIGINT) AS n_messages,
           '<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10) AS text
    FROM n WHERE parent IS NULL
    UNION ALL
    SELECT c.conv_id, c.turn, CAST(w.score + c.score AS BIGINT), w.n_messages + 1,
           w.text || '<|' || c.role || '|>' || chr(10) || c.text || chr(10) || '<|end|>' || chr(10)
    FROM walk w JOIN n c ON c.conv_id = w.conv_id AND c.parent = w.turn
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, n_messages DESC, turn) AS rank
    FROM walk w WHERE NOT EXISTS (SELECT 1 FROM n c WHERE c.conv_id = w.conv_id AND c.parent = w.turn)
)
SELECT conv_id, rank, turn AS leaf_turn, score, n_messages, text FROM leaves WHERE rank <= 3
"""


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_documents(spark, sf_dir))


QUERIES["op5_secret_scan"] = op5_secret_scan


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir))


QUERIES["op7_license_scan"] = op7_license_scan

"""The registered queries of the operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trussline.llm import forest, language_id, lm_scoring, matroska, mixing, pieces, pii, quotes, repair, simhash, token_counts, token_files, tokenizer_alignment


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(_table(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_report(_table(spark, sf_dir, "documents"))


def op3_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.vector_groups(_table(spark, sf_dir, "embeddings"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_report(_table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoding_report(_table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.format_conversations(_table(spark, sf_dir, "conversations"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(_table(spark, sf_dir, "documents"))


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.media_report(_table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair_report(_table(spark, sf_dir, "conversations"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenizer_alignment.alignment_report(_table(spark, sf_dir, "documents"))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_report(_table(spark, sf_dir, "documents"))


def plain_pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain counts of op6, which SQL can express."""
    return op6_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payloads of op10 as read back from the files, which SQL can express."""
    return op10_matroska(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


_PLAIN_PII_SQL = """
WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
  SELECT row_id, 'email' AS kind, unnest(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+')) AS m FROM d
  UNION ALL SELECT row_id, 'ip', unnest(regexp_extract_all(t, '[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)')) FROM d
  UNION ALL SELECT row_id, 'card', unnest(regexp_extract_all(t, '[0-9]([\\x20-]?[0-9])+')) FROM d
  UNION ALL SELECT row_id, 'phone', unnest(regexp_extract_all(t, '\\+[0-9][\\x20().0-9-]+[0-9]')) FROM d),
told AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS digits FROM found),
good AS (
  SELECT row_id, kind FROM told WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS INTEGER), 999) > 255)) = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    ELSE length(digits) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda k:
      CASE WHEN k % 2 = 1 THEN digits[length(digits) - k + 1]::INTEGER
      ELSE (digits[length(digits) - k + 1]::INTEGER * 2) // 10 + (digits[length(digits) - k + 1]::INTEGER * 2) % 10 END)) % 10 = 0 END)
SELECT d.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone
FROM d LEFT JOIN good USING (row_id) GROUP BY d.row_id, d.doc_id
"""

_PAYLOAD_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT *, octet_length(encode(t)) AS n FROM d)
SELECT doc_id, n::BIGINT AS n_bytes, (greatest(1, (n + 191) // 192) * 192)::BIGINT AS payload_bytes,
  sha256(t || repeat(' ', (greatest(1, (n + 191) // 192) * 192 - n)::BIGINT)) AS payload_sha256 FROM s
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_rp_forest": op3_rp_forest,
        "op4_token_counts": op4_token_counts,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_pii": op6_pii,
        "op7_mixing": op7_mixing,
        "op8_quotation_linking": op8_quotation_linking,
        "op9_simhash": op9_simhash,
        "op10_matroska": op10_matroska,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_tokenizer_alignment": op12_tokenizer_alignment,
        "op13_token_files": op13_token_files,
        "plain_pii_counts": plain_pii_counts,
        "media_payloads": media_payloads,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_mixing": mixing.MIX_SQL,
        "op11_conversation_repair": repair.REPAIR_SQL,
        "plain_pii_counts": _PLAIN_PII_SQL,
        "media_payloads": _PAYLOAD_SQL,
    }

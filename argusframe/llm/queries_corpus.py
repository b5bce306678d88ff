"""Queries op6 and op8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .mixing import mix_table
from .quality import quality


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix by source weights takes of each document."""
    return mix_table(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS key,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce('s' || doc_id, 'n') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents
), per AS (
  SELECT key, sum(size)::BIGINT AS source_size, [3, 1, 2][(row_number() OVER (ORDER BY key) - 1) % 3 + 1] AS w FROM sized GROUP BY key
), ranked AS (
  SELECT *, 2 * source_size AS cap, 2 * source_size / w AS ratio,
         1.5::DOUBLE * (SELECT sum(source_size) FROM per)::DOUBLE AS total, (SELECT sum(w) FROM per)::DOUBLE AS weights
  FROM per
), stops AS (
  SELECT *, ratio <= (total - coalesce(sum(cap) OVER before, 0)::DOUBLE) / (weights - coalesce(sum(w) OVER before, 0)::DOUBLE) AS stop
  FROM ranked
  WINDOW before AS (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aims AS (
  SELECT key, source_size,
         CASE WHEN stop THEN cap::DOUBLE
              ELSE (total - coalesce((SELECT sum(cap) FROM stops WHERE stop), 0)::DOUBLE) / (SELECT sum(w) FROM stops WHERE NOT stop)::DOUBLE * w END AS target
  FROM stops
), planned AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM aims
), placed AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS budget,
         sum(size) OVER (PARTITION BY key ORDER BY h) - sum(size) OVER (PARTITION BY key, h) AS before,
         sum(size) OVER (PARTITION BY key, h) AS words, count(*) OVER (PARTITION BY key, h) AS n, row_number() OVER (PARTITION BY key, h) AS nth
  FROM sized JOIN planned USING (key)
)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN before + words <= budget OR before <= budget AND nth <= floor((budget - before) * n / words + 0.5) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM placed
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of each document."""
    found = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS body,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT uid, unnest(range(1, len(words) - 6)) AS i, words FROM d WHERE len(words) > 8
), hashed AS (
  SELECT uid, i, count(*) OVER (PARTITION BY uid, array_to_string(words[i:i + 7], ' ')) AS n FROM windows
), covered AS (
  SELECT uid, count(DISTINCT i + k) AS n_repeat_words FROM hashed, range(8) AS r(k) WHERE n > 1 GROUP BY uid
), m AS (
  SELECT doc_id, body, len(words)::BIGINT AS n_words, length(regexp_replace(body, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(body) - length(translate(body, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN covered USING (uid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR length(regexp_replace(body, '[^\p{L}]', '', 'g')) < 0.5 * word_chars
            OR length(body) - length(replace(body, '!', '')) > 0.5 * n_words OR n_symbols > 0.25 * n_words
            OR n_dup_lines > 0.3 * n_lines OR word_chars < 1.5 * n_words OR word_chars > 25 * n_words) AS kept
FROM b
"""

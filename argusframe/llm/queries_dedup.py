"""Queries op1, op2 and op12."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .exact_dedup import exact_groups
from .simhash import near_groups
from .suffix_dedup import suffix_dedup


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the copy of it that stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_groups(docs).select(F.col("row.doc_id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's SimHash and the smallest doc_id that near-duplicate links reach."""
    groups = near_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("group").alias("component_id"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the strings of 50 bytes that one with a smaller doc_id has too."""
    found = suffix_dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s.getField("end") - s.getField("start"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))



#: Every string of 50 bytes, as hexadecimal digits, with the smallest doc_id that has it; texts are cut in pieces first, in which places are found faster.
OP12_SQL = """
WITH d AS (SELECT row_number() OVER () AS i, doc_id, coalesce(doc_id, 9223372036854775807) AS doc, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT i, doc, c, substring(x, 2 * c + 1, 1098) AS y FROM (SELECT *, unnest(range(0, greatest(length(x) // 2 - 49, 0), 500)) AS c FROM d)),
s AS (SELECT i, doc, c + p AS p, substring(y, 2 * p + 1, 100) AS s FROM (SELECT *, unnest(range(length(y) // 2 - 49)) AS p FROM c)),
m AS (SELECT i, p FROM s JOIN (SELECT s, min(doc) AS least FROM s GROUP BY s HAVING count(*) > 1) USING (s) WHERE least < doc),
r AS (SELECT i, p, sum(new) OVER (PARTITION BY i ORDER BY p) AS run FROM (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY i ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM m)),
g AS (SELECT *, lag(e, 1, 0) OVER (PARTITION BY i ORDER BY a) AS z FROM (SELECT i, run, min(p) AS a, max(p) + 50 AS e FROM r GROUP BY i, run)),
k AS (SELECT i, count(*) AS n_spans, sum(e - a) AS n_removed, string_agg(substring(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || any_value(substring(x, 2 * last + 1)) AS kept
      FROM (SELECT g.*, x, max(e) OVER (PARTITION BY i) AS last FROM g JOIN d USING (i)) GROUP BY i)
SELECT doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256
FROM d LEFT JOIN k USING (i)
"""

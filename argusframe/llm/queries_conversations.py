"""Query op13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .trie import prefix_trie


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 goes bit by bit, lowest first.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), c AS (
  SELECT *, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: list_transform(range(8), lambda i: (ord(ch) >> i) & 1))),
    lambda a, b: xor(a >> 1, CASE WHEN xor(a, b) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc FROM t
), r AS (
  SELECT c.conv_id, coalesce(b.turns, [])[:h] || c.turns[h + 1:] AS turns
  FROM (SELECT *, xor(crc, 4294967295) % 4 AS h FROM c) c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 20
), m AS (
  SELECT conv_id, d AS depth, turns[:d] AS path, CASE WHEN d > 0 THEN turns[:d - 1] END AS parent, len(turns) = d AS ends,
         CASE WHEN d > 0 THEN len(regexp_extract_all(turns[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS words
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM r)
), n AS (
  SELECT path, any_value(parent) AS parent, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM m GROUP BY path
), k AS (SELECT parent, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY parent
), f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.parent = n.path
), s AS (
  SELECT path[:d] AS path, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM f) GROUP BY 1
)
SELECT f.conv_id, f.depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s ON s.path = f.path LEFT JOIN n p ON p.path = f.parent
"""

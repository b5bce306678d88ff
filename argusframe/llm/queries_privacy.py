"""Queries op4 and op7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .licences import KNOWN, RESERVED_LINE, bodies, canonical_sql, licences
from .privacy import surrogated


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest, licence and notices of each document."""
    return licences(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumnRenamed("id", "doc_id")


_ENTIRE = r"trim(regexp_replace({}, '[ \n]+', ' ', 'g'))"


def op4_sql() -> str:
    """The same in DuckDB's SQL, which takes the known texts as they are and makes their canonical forms itself."""
    values = lambda known: ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in known)
    entire = lambda text: _ENTIRE.format(canonical_sql(text))
    unreserved = f"regexp_replace(lower(body), '{RESERVED_LINE}', '{chr(92)}1', 'g')"
    return f"""
WITH known AS (SELECT sha256({entire("t")}) AS digest, min(licence) AS licence FROM (VALUES {values(KNOWN)}) AS v(licence, t) GROUP BY 1),
every AS (SELECT digest, min(licence) AS licence FROM (FROM known UNION ALL SELECT sha256({entire("t")}), licence FROM (VALUES {values(bodies())}) AS v(licence, t)) GROUP BY digest),
c AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS body, {canonical_sql("coalesce(text, '')")} AS lines FROM documents),
d AS (SELECT *, sha256({_ENTIRE.format("lines")}) AS digest, CASE WHEN contains(lines, 'all rights reserved') THEN sha256({entire(unreserved)}) END AS other FROM c),
notices AS (
  SELECT uid, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices
  FROM (SELECT uid, unnest(string_split(lines, chr(10))) AS line FROM c) JOIN known ON sha256(line) = digest GROUP BY uid
)
SELECT doc_id, d.digest, coalesce(w.licence, o.licence) AS licence, coalesce(notices, '') AS notices
FROM d LEFT JOIN every w ON w.digest = d.digest LEFT JOIN every o ON o.digest = d.other LEFT JOIN notices USING (uid)
"""


#: The key of the query below, so that its results can be compared. A job passes a secret one of its own.
QUERY_KEY = b"key of the query"


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with surrogates for what it tells of persons."""
    found = surrogated(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    return found.select(F.col("id").alias("doc_id"), "text", "n_entities")

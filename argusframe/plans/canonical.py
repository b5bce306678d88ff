"""The canonical security-event view over the `events` table, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CANONICAL_SQL = """
SELECT event_id, ts AS timestamp,
  CASE event_type WHEN 'error' THEN 'authentication' WHEN 'signup' THEN 'authorization' WHEN 'purchase' THEN 'file' WHEN 'click' THEN 'network' ELSE 'web' END AS event_type,
  CASE WHEN event_id % 2 = 0 THEN concat('10.0.', CAST(user_id % 3 AS STRING), '.', CAST(1 + user_id % 200 AS STRING))
       WHEN user_id % 17 = 0 THEN '45.227.255.206' WHEN user_id % 17 = 1 THEN concat('45.155.205.', CAST(1 + user_id % 200 AS STRING))
       ELSE concat('45.227.', CAST(user_id % 3 AS STRING), '.', CAST(1 + user_id % 200 AS STRING)) END AS source_ip,
  CASE WHEN event_id % 3 = 0 THEN '8.8.8.8' WHEN event_id % 3 = 1 THEN concat('192.168.1.', CAST(1 + event_id % 50 AS STRING)) END AS dest_ip,
  1024 + event_id % 40000 AS source_port,
  CASE event_id % 8 WHEN 0 THEN 22 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 3389 WHEN 4 THEN 80 WHEN 5 THEN 9999 WHEN 6 THEN 445 END AS dest_port,
  CASE WHEN user_id % 40 = 0 THEN 'root' WHEN user_id % 41 = 0 THEN 'svc_backup' ELSE concat('user', CAST(user_id AS STRING)) END AS source_user,
  CASE event_type WHEN 'error' THEN 'logon_failed' WHEN 'signup' THEN 'user_created' WHEN 'purchase' THEN 'write' WHEN 'click' THEN 'connect' ELSE 'read' END AS action,
  CASE WHEN event_type = 'error' THEN 'failure' WHEN event_type IN ('signup', 'purchase') THEN 'success' END AS result,
  CASE WHEN value < 5 THEN 'info' WHEN value < 20 THEN 'low' WHEN value < 40 THEN 'medium' WHEN value < 80 THEN 'high' ELSE 'critical' END AS severity,
  concat(event_type, ' by user', CAST(user_id AS STRING), CASE WHEN event_id % 10 = 0 THEN ' Failed password' ELSE '' END) AS message,
  CASE WHEN event_type = 'error' THEN 'sshd' WHEN event_type = 'view' THEN 'nginx' ELSE 'app' END AS product,
  CAST(floor(value * 1000000) AS BIGINT) AS bytes_sent,
  CASE WHEN event_id % 7 = 0 THEN concat('h', CAST(user_id % 5 AS STRING), '.malware-c2.example.net') WHEN event_id % 7 = 1 THEN 'www.example.org' END AS dns_query,
  CASE WHEN event_type = 'view' THEN concat('/a/', CASE WHEN event_id % 5 = 0 THEN '../etc/passwd' ELSE 'index.html' END) END AS uri_path,
  event_id % 2 = 0 AS source_is_internal, CASE WHEN event_id % 3 < 2 THEN event_id % 3 = 1 END AS dest_is_internal,
  CASE WHEN event_id % 2 = 0 AND event_id % 3 = 1 THEN 'internal' WHEN event_id % 2 = 0 THEN 'outbound' WHEN event_id % 3 = 1 THEN 'inbound' ELSE 'external' END AS direction,
  user_id, value, props
FROM events
"""
#: To stand before an oracle query.
WITH = f"WITH canon AS ({CANONICAL_SQL})\n"


def canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(CANONICAL_SQL.replace("FROM events", "FROM {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))

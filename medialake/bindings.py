"""Adapter views that show the driver's tables in the shapes of the media domain.

The SQL runs in Spark and in other engines alike; :func:`view` gives a view as a
DataFrame, :func:`cte` the same text for an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS = {
    "v_events": """
SELECT CAST(event_id AS STRING) AS event_id, ts AS occurred_at,
  CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'youtube_click'
    WHEN 'signup' THEN 'audio_play' WHEN 'error' THEN 'audio_progress'
    ELSE CASE WHEN event_id % 2 = 0 THEN 'download' ELSE 'audio_complete' END END AS event_type,
  CAST(user_id AS STRING) AS visitor_id_hash,
  CASE k % 3 WHEN 0 THEN 'sermon' WHEN 1 THEN 'study' ELSE '' END AS content_type,
  CAST(k AS STRING) AS content_id, concat('/p/', CAST(k % 20 AS STRING)) AS page_path,
  CASE WHEN event_type = 'error' THEN least(value, CAST(60 AS DOUBLE)) END AS listened_seconds,
  CAST(1 + (event_id % 4) * 0.25 AS DOUBLE) AS playback_rate,
  CAST(floor(value * 1000) AS BIGINT) AS bytes_estimated
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k FROM events) e""",
    "v_visitors": """
SELECT CAST(user_id AS STRING) AS visitor_id_hash, min(ts) AS first_seen_at, max(ts) AS last_seen_at
FROM events WHERE user_id % 7 <> 0 GROUP BY user_id""",
    "v_gold": """
SELECT CAST(o_orderkey AS STRING) AS canonical_sermon_id,
  CAST(CAST(o_orderdate AS DATE) AS STRING) AS preaching_date,
  CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderpriority END AS title,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE c_name END AS preacher_name,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE c_mktsegment END AS serie,
  concat(n_name, ' ', CAST(o_orderkey % 50 + 1 AS STRING)) AS text_reference,
  CASE o_orderkey % 3 WHEN 0 THEN 'https://youtube.com/watch?v=x' WHEN 1 THEN 'youtube.com/x' END AS youtube_link,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('https://example.org/', CAST(o_orderkey AS STRING)) END AS wordpress_link,
  o_totalprice / 20 AS duration_seconds
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "v_versions": """
SELECT CAST(conv_id AS STRING) AS canonical_sermon_id, CAST(turn + 1 AS INT) AS transcript_version,
  concat('2024-01-', lpad(CAST(turn + 1 AS STRING), 2, '0')) AS created_at, role AS model_name, text AS transcript_text
FROM conversations""",
    "v_metadata": """
SELECT CAST(s_nationkey AS STRING) AS canonical_sermon_id, 'wordpress' AS source_system,
  concat('s', CAST(s_suppkey AS STRING)) AS source_item_id,
  CASE WHEN s_suppkey % 3 = 0 THEN '' WHEN s_suppkey % 3 = 1 THEN 'Nome Sobrenome' ELSE s_name END AS preacher_name,
  CASE WHEN s_acctbal < 0 THEN '' ELSE concat('T', CAST(s_suppkey AS STRING)) END AS title,
  CAST(NULL AS STRING) AS serie, '2024-01-01' AS processed_at FROM supplier
UNION ALL
SELECT CAST(c_nationkey AS STRING), 'youtube', concat('c', CAST(c_custkey AS STRING)), c_name,
  CASE WHEN c_acctbal < 0 THEN '' ELSE concat('T', CAST(c_custkey AS STRING)) END,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END, '2024-01-02' FROM customer""",
    "v_candidates": """
SELECT CAST(CAST(o_orderdate AS DATE) AS STRING) AS preaching_date, CAST(o_orderkey AS STRING) AS video_id,
  max(l_shipdate) AS published_at,
  CASE WHEN o_orderkey % 4 = 0 THEN 'P0D' WHEN o_orderkey % 4 = 1 THEN '' ELSE concat('PT', CAST(count(*) AS STRING), 'H', CAST(o_orderkey % 60 AS STRING), 'M') END AS duration,
  max(o_orderstatus) = 'F' AS has_playlists
FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderdate""",
    "v_text": """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "v_titles": """
SELECT p_partkey, CASE p_partkey % 4
    WHEN 0 THEN concat('Estudo CTB ', p_name, ' [', p_brand, ']')
    WHEN 1 THEN concat('CTB ', p_name, ' | CTB 20', lpad(CAST(p_size % 25 AS STRING), 2, '0'))
    WHEN 2 THEN concat(p_name, ' | Romanos ', CAST(p_size AS STRING), ':', CAST(p_partkey % 30 + 1 AS STRING), ' | ', p_brand)
    ELSE concat('Conferência ', p_name, ' - ', p_type) END AS title
FROM part""",
    "v_metrics": """
SELECT CAST(CAST(ts AS DATE) AS STRING) AS run_id, event_type AS metric_key, count(*) AS value,
  CASE WHEN event_type = 'error' THEN NULL ELSE sum(count(*)) OVER (PARTITION BY CAST(ts AS DATE)) END AS denominator
FROM events GROUP BY CAST(ts AS DATE), event_type""",
    "v_runs": """
SELECT DISTINCT CAST(CAST(ts AS DATE) AS STRING) AS run_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS calculated_at,
  CASE WHEN extract(day FROM ts) % 9 = 0 THEN 'failed' ELSE 'success' END AS status FROM events""",
}

_NAMES = re.compile(r"\b(FROM|JOIN) (" + "|".join(TABLES) + r")\b")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the schema comes from the file."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter view over the tables in ``sf_dir``."""
    return spark.sql(_NAMES.sub(lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet` {m[2] if ' ' not in m[2] else ''}", _aliased(VIEWS[name])))


def _aliased(sql: str) -> str:
    # a table that has an alias of its own keeps it
    return sql.replace("FROM documents d LEFT JOIN labels l", "FROM (SELECT * FROM documents) d LEFT JOIN (SELECT * FROM labels) l")


def cte(*names: str, more: str = "") -> str:
    """``WITH`` clause that defines views for an oracle query; ``more`` is put behind them."""
    parts = [f"{n} AS ({VIEWS[n].strip()})" for n in names] + ([more.strip()] if more else [])
    return "WITH " + ",\n".join(parts) + "\n"

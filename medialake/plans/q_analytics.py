"""Queries over the event stream: series, rankings, key figures."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from medialake.bindings import cte, table, view
from medialake.functions import times as t
from medialake.operators import aggs, filters, joins
from medialake.plans.registry import query

START, END = dt.date(2024, 1, 5), dt.date(2024, 1, 25)
PERIOD = t.resolve_period("2024-01-05", "2024-01-25", 30, dt.date(2024, 1, 31), 180)
_LOCAL = "CAST(timezone('America/Sao_Paulo', timezone('UTC', {})) AS DATE)"
_DAY = _LOCAL.format("occurred_at")
_IN = f"occurred_at >= TIMESTAMP '{PERIOD.start_utc}' AND occurred_at < TIMESTAMP '{PERIOD.end_utc}'"
_OWN = f"own AS (SELECT * FROM v_events WHERE {_IN})"


def period_events(spark, sf_dir):
    return filters.time_range(view(spark, sf_dir, "v_events"), "occurred_at", PERIOD.start_utc, PERIOD.end_utc)


_SERIES = f"""
counted AS (SELECT {_DAY} AS day, count(*) FILTER (event_type = 'page_view') AS views, count(*) FILTER (event_type = 'audio_play') AS plays,
  count(*) FILTER (event_type = 'download') AS downloads FROM v_events GROUP BY 1),
daily AS (SELECT d.day, coalesce(views, 0) AS views, coalesce(plays, 0) AS plays, coalesce(downloads, 0) AS downloads
  FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-05', DATE '2024-01-25', INTERVAL 1 DAY)) AS DATE) AS day) d LEFT JOIN counted c ON d.day = c.day)"""


@query(cte("v_events", more=_SERIES) + "SELECT CAST(day AS VARCHAR) AS day, views, plays, downloads FROM daily")
def ts1_daily_series(spark, sf_dir):
    return t.daily_series(view(spark, sf_dir, "v_events"), START, END).withColumn("day", F.col("day").cast("string"))


@query(cte("v_events", more=_SERIES) + "SELECT CAST(CAST(date_trunc('week', day) AS DATE) AS VARCHAR) AS bucket, CAST(sum(views) AS BIGINT) AS views, CAST(sum(plays) AS BIGINT) AS plays, CAST(sum(downloads) AS BIGINT) AS downloads FROM daily GROUP BY 1")
def ts2_weekly(spark, sf_dir):
    return t.rollup_series(ts1_daily_series(spark, sf_dir), "week")


@query(cte("v_events", more=_SERIES) + "SELECT strftime(day, '%Y-%m') AS bucket, CAST(sum(views) AS BIGINT) AS views, CAST(sum(plays) AS BIGINT) AS plays, CAST(sum(downloads) AS BIGINT) AS downloads FROM daily GROUP BY 1")
def ts2_monthly(spark, sf_dir):
    return t.rollup_series(ts1_daily_series(spark, sf_dir), "month")


@query(cte("v_events") + f"SELECT CAST({_DAY} AS VARCHAR) AS day, count(*) AS n FROM v_events GROUP BY 1")
def d01_local_dates(spark, sf_dir):
    return view(spark, sf_dir, "v_events").groupBy(t.local_date("occurred_at").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(cte("v_events") + "SELECT CAST(CAST(occurred_at - INTERVAL 3 HOUR AS DATE) AS VARCHAR) AS day, count(*) AS n FROM v_events GROUP BY 1")
def d02_fixed_offset_dates(spark, sf_dir):
    return view(spark, sf_dir, "v_events").groupBy(t.fixed_offset_date("occurred_at").cast("string").alias("day")).agg(F.count("*").alias("n"))


@query(cte("v_events", more=_OWN) + "SELECT event_id, occurred_at, event_type FROM own")
def f08_time_range(spark, sf_dir):
    return period_events(spark, sf_dir).select("event_id", "occurred_at", "event_type")


@query(cte("v_events", more=_OWN) + "SELECT event_type, count(*) AS n, count(*) FILTER (content_type = 'sermon' OR event_type = 'page_view') AS own FROM own GROUP BY 1")
def f09_content_scope(spark, sf_dir):
    own = filters.content_scope("sermon") | (F.col("event_type") == "page_view")
    return period_events(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(own).alias("own"))


_STATS = """
stats AS (SELECT content_type, content_id, count(*) FILTER (event_type = 'audio_play') AS plays,
  count(DISTINCT visitor_id_hash) FILTER (event_type = 'audio_play') AS listeners, count(*) FILTER (event_type = 'audio_complete') AS completions,
  count(*) FILTER (event_type = 'download') AS downloads, coalesce(sum(listened_seconds) FILTER (event_type = 'audio_progress'), 0.0) AS seconds
  FROM own WHERE content_type <> '' AND content_id <> '' GROUP BY 1, 2)"""
_STATS_OUT = "content_type, content_id, plays, listeners, completions, downloads, round(seconds, 6) AS seconds, coalesce(round_even(completions * 100.0 / nullif(plays, 0), 1), 0.0) AS completion_rate, round_even(seconds / 3600, 1) AS hours"


def _stats(spark, sf_dir):
    return aggs.content_stats(period_events(spark, sf_dir)).withColumn("seconds", F.round("seconds", 6))


@query(cte("v_events", more=_OWN + "," + _STATS) + f"SELECT {_STATS_OUT} FROM stats")
def a11_content_stats(spark, sf_dir):
    return _stats(spark, sf_dir)


@query(cte("v_events", more=_OWN + "," + _STATS) + "SELECT content_type, content_id, plays, downloads, completions FROM stats ORDER BY plays DESC, downloads DESC, completions DESC, content_type, content_id LIMIT 25")
def o03_top_content(spark, sf_dir):
    order = [F.desc("plays"), F.desc("downloads"), F.desc("completions"), F.asc("content_type"), F.asc("content_id")]
    return aggs.top_k(_stats(spark, sf_dir), order, 25).select("content_type", "content_id", "plays", "downloads", "completions")


@query(cte("v_events", more=_OWN + "," + _STATS) + "SELECT content_type, content_id, downloads, plays FROM stats WHERE downloads > 0 ORDER BY downloads DESC, plays DESC, content_type, content_id LIMIT 15")
def o03_top_downloads(spark, sf_dir):
    order = [F.desc("downloads"), F.desc("plays"), F.asc("content_type"), F.asc("content_id")]
    return aggs.top_k(_stats(spark, sf_dir).where("downloads > 0"), order, 15).select("content_type", "content_id", "downloads", "plays")


@query(cte("v_events", more=_OWN) + "SELECT page_path, count(*) AS views FROM own WHERE event_type = 'page_view' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def o02_top_pages(spark, sf_dir):
    views = period_events(spark, sf_dir).where("event_type = 'page_view'").groupBy("page_path").agg(F.count("*").alias("views"))
    return aggs.top_k(views, [F.desc("views"), F.asc("page_path")], 15)


_SPLIT = f"""
split AS (SELECT count(*) FILTER (first_seen >= DATE '{PERIOD.start}') AS new_visitors, count(*) FILTER (first_seen IS NULL OR first_seen < DATE '{PERIOD.start}') AS returning_visitors
  FROM (SELECT DISTINCT o.visitor_id_hash, {_LOCAL.format("first_seen_at")} AS first_seen FROM own o LEFT JOIN v_visitors v ON o.visitor_id_hash = v.visitor_id_hash))"""


@query(cte("v_events", "v_visitors", more=_OWN + "," + _SPLIT) + "SELECT * FROM split")
def a13_visitor_split(spark, sf_dir):
    return aggs.visitor_split(period_events(spark, sf_dir), view(spark, sf_dir, "v_visitors"), PERIOD.start, t.ZONE)


@query(
    cte("v_events", "v_visitors", more=_OWN + "," + _SPLIT)
    + """, k AS (SELECT count(*) FILTER (event_type = 'page_view') AS page_views, count(DISTINCT visitor_id_hash) AS visitors, count(*) FILTER (event_type = 'audio_play') AS plays,
  count(DISTINCT visitor_id_hash || '|' || content_type || '|' || content_id) FILTER (event_type = 'audio_play') AS unique_plays, count(*) FILTER (event_type = 'audio_complete') AS completions,
  count(*) FILTER (event_type = 'download') AS downloads, round(coalesce(sum(listened_seconds) FILTER (event_type = 'audio_progress'), 0.0), 6) AS listened_seconds,
  CAST(coalesce(sum(bytes_estimated), 0) AS BIGINT) AS bytes, count(*) FILTER (event_type = 'youtube_click') AS youtube_clicks FROM own)
SELECT k.*, split.*, coalesce(round_even(completions * 100.0 / nullif(plays, 0), 1), 0.0) AS completion_rate FROM k, split"""
)
def a12_kpis(spark, sf_dir):
    return aggs.kpis(period_events(spark, sf_dir), view(spark, sf_dir, "v_visitors"), PERIOD.start, t.ZONE).withColumn("listened_seconds", F.round("listened_seconds", 6))


@query(
    cte("v_events", "v_gold", more=_OWN)
    + """, played AS (SELECT content_id, count(*) AS n FROM own WHERE event_type = 'audio_play' AND content_type = 'sermon' GROUP BY 1),
named AS (SELECT n, coalesce(preacher_name, '') AS p, coalesce(serie, '') AS s, split_part(trim(text_reference), ' ', 1) AS b FROM played JOIN v_gold ON content_id = canonical_sermon_id)
SELECT dimension, name, CAST(sum(n) AS BIGINT) AS plays FROM (SELECT 'speaker' AS dimension, p AS name, n FROM named UNION ALL SELECT 'serie', s, n FROM named UNION ALL SELECT 'book', b, n FROM named) WHERE name <> '' GROUP BY 1, 2"""
)
def a14_plays_by_dims(spark, sf_dir):
    return aggs.plays_by_dims(period_events(spark, sf_dir), view(spark, sf_dir, "v_gold"))


@query(cte("v_events", more=_OWN) + "SELECT coalesce(nullif(playback_rate, 0), 1) AS rate, round(sum(coalesce(listened_seconds, 0)), 6) AS seconds FROM own WHERE event_type = 'audio_progress' GROUP BY 1")
def a15_seconds_by_rate(spark, sf_dir):
    return aggs.seconds_by_rate(period_events(spark, sf_dir)).withColumn("seconds", F.round("seconds", 6))


@query(cte("v_events", more=_OWN) + "SELECT event_type, count(*) AS clicks FROM own WHERE event_type LIKE '%\\_click' ESCAPE '\\' GROUP BY 1")
def a16_clicks(spark, sf_dir):
    return aggs.clicks_by_type(period_events(spark, sf_dir))


@query(cte("v_events") + f"SELECT CAST(CAST(date_trunc('week', {_DAY}) AS DATE) AS VARCHAR) AS week, strftime({_DAY}, '%Y-%m') AS month, count(*) AS n FROM v_events GROUP BY 1, 2")
def d06_week_and_month(spark, sf_dir):
    day = t.local_date("occurred_at")
    return view(spark, sf_dir, "v_events").groupBy(t.week_start(day).cast("string").alias("week"), t.month_key(day).alias("month")).agg(F.count("*").alias("n"))


@query("SELECT event_id, least(greatest(value, 5.0), 60.0) AS clamped FROM events")
def d07_clamp(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", t.clamp("value", 5.0, 60.0).alias("clamped"))


@query(cte("v_events") + "SELECT content_id, coalesce(round_even(count(*) FILTER (event_type = 'download') * 100.0 / nullif(count(*) FILTER (event_type = 'audio_play'), 0), 1), 0.0) AS percent FROM v_events GROUP BY 1")
def d08_percent(spark, sf_dir):
    load, play = (F.count_if(F.col("event_type") == k) for k in ("download", "audio_play"))
    return view(spark, sf_dir, "v_events").groupBy("content_id").agg(t.pct(load, play).alias("percent"))


@query(
    cte("v_events")
    + """SELECT event_id, CAST(coalesce(CASE event_type WHEN 'download' THEN bytes_estimated
  WHEN 'audio_progress' THEN round_even(bytes_estimated * least(1.0, coalesce(listened_seconds, 0) * playback_rate / 60.0), 0) END, 0) AS BIGINT) AS bytes FROM v_events"""
)
def d09_bytes(spark, sf_dir):
    e = view(spark, sf_dir, "v_events")
    return e.select("event_id", t.bytes_estimate("event_type", F.col("bytes_estimated"), F.col("listened_seconds"), F.col("playback_rate"), F.lit(60.0)).alias("bytes"))


@query(
    cte("v_events", "v_gold")
    + """SELECT event_id, coalesce(nullif(title, ''), content_id) AS content_title, coalesce(preacher_name, '') AS content_speaker
FROM v_events LEFT JOIN v_gold ON content_type = 'sermon' AND content_id = canonical_sermon_id"""
)
def j09_enrich(spark, sf_dir):
    talks = view(spark, sf_dir, "v_gold")
    return joins.enrich_content(view(spark, sf_dir, "v_events"), talks, talks.select(F.col("canonical_sermon_id").alias("study_id"), "title").where("false")).select("event_id", "content_title", "content_speaker")


@query(
    cte("v_events", "v_gold")
    + """SELECT event_id, CASE content_type WHEN 'sermon' THEN '/audio/' || g.canonical_sermon_id WHEN 'study' THEN '/study/' || g.canonical_sermon_id END AS asset_path
FROM v_events LEFT JOIN v_gold g ON content_id = g.canonical_sermon_id AND content_type <> ''"""
)
def j21_asset_of(spark, sf_dir):
    gold = view(spark, sf_dir, "v_gold")
    media = gold.select("canonical_sermon_id", F.concat(F.lit("/audio/"), "canonical_sermon_id").alias("local_path"), "duration_seconds")
    studies = gold.select(F.col("canonical_sermon_id").alias("study_id"), F.lit("").alias("resource_id"), F.concat(F.lit("/study/"), "canonical_sermon_id").alias("local_path"), "duration_seconds")
    return joins.asset_of(view(spark, sf_dir, "v_events").withColumn("resource_id", F.lit("")), media, studies).select("event_id", "asset_path")


@query(
    cte("v_metrics", "v_runs")
    + """, good AS (SELECT run_id, calculated_at, lag(run_id) OVER (ORDER BY calculated_at, run_id) AS previous FROM v_runs WHERE status = 'success')
SELECT m.run_id, m.metric_key, m.value, p.value AS previous_value, m.value - p.value AS delta, round_even(m.value * 100.0 / nullif(m.denominator, 0), 1) AS percent
FROM v_metrics m JOIN good g ON m.run_id = g.run_id LEFT JOIN v_metrics p ON p.run_id = g.previous AND p.metric_key = m.metric_key"""
)
def w04_metric_delta(spark, sf_dir):
    from medialake.operators.pick import metric_delta

    return metric_delta(view(spark, sf_dir, "v_metrics"), view(spark, sf_dir, "v_runs"))


@query(
    cte("v_metrics", "v_runs")
    + """SELECT m.run_id, calculated_at, metric_key, value, CAST(denominator AS BIGINT) AS denominator, coalesce(round_even(value * 100.0 / nullif(denominator, 0), 1), 0.0) AS percent
FROM v_metrics m JOIN v_runs r ON m.run_id = r.run_id AND status = 'success' ORDER BY calculated_at DESC, metric_key LIMIT 60"""
)
def ts4_metric_history(spark, sf_dir):
    return t.metric_history(view(spark, sf_dir, "v_runs"), view(spark, sf_dir, "v_metrics"), 60)


@query(cte("v_runs") + "SELECT run_id, calculated_at, status FROM v_runs WHERE status = 'success' ORDER BY calculated_at DESC, run_id DESC LIMIT 1")
def w14_pick_run(spark, sf_dir):
    from medialake.operators.pick import pick_run

    return pick_run(view(spark, sf_dir, "v_runs"))


@query(
    cte("v_runs")
    + """SELECT count(*) FILTER (status = 'failed' AND calculated_at >= TIMESTAMP '2024-01-13' AND calculated_at <= TIMESTAMP '2024-01-20') AS failed_7d,
  coalesce(max(calculated_at) FILTER (status = 'success') < TIMESTAMP '2024-01-12', true) AS stale FROM v_runs"""
)
def a26_freshness(spark, sf_dir):
    return aggs.freshness(view(spark, sf_dir, "v_runs"), dt.datetime(2024, 1, 20))


@query(cte("v_runs") + "SELECT * FROM (SELECT run_id, calculated_at, status FROM v_runs ORDER BY calculated_at DESC, run_id DESC LIMIT 12)")
def o05_tail(spark, sf_dir):
    return aggs.tail(view(spark, sf_dir, "v_runs"), 12, "calculated_at", "run_id")


@query("SELECT user_id, min(ts) AS first_seen_at, max(ts) AS last_seen_at FROM events GROUP BY user_id")
def k07_touch(spark, sf_dir):
    from medialake.sources.tables import touch

    e = table(spark, sf_dir, "events")
    old = e.where("ts < TIMESTAMP '2024-01-15'").groupBy("user_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("last_seen_at"))
    return touch(old, e.select("user_id", F.col("ts").alias("at")), "user_id")


@query("SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-21'")
def k13_retain(spark, sf_dir):
    from medialake.sources.tables import retain

    return retain(table(spark, sf_dir, "events"), "ts", 10, dt.datetime(2024, 1, 31)).select("event_id", "ts")


@query("SELECT event_id, event_type FROM events")
def k06_insert_absent(spark, sf_dir):
    from medialake.sources.tables import insert_absent

    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    return insert_absent(e.where("event_id % 3 = 0"), e.unionByName(e.where("event_id % 5 = 0")), "event_id")

"""Queries over stored tables: changes to bucketed tables, scans with predicates, documents behind a pointer."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medialake.bindings import cte, table, view
from medialake.operators import aggs, grams, joins
from medialake.plans import quality, serving
from medialake.plans.q_catalog import _UP, _upsert_frames
from medialake.plans.registry import query
from medialake.sources import readers
from medialake.sources.buckets import BucketTable
from medialake.sources.days import DayTable
from medialake.sources.scratch import fresh_path
from medialake.sources.scratch import stored as scratch_stored
from medialake.sources.tables import CSV_COLUMNS, Policy, export_csv
from medialake.streaming import visitors

_CUSTOMER = "k long, name string, serie string, bal double"


def _bucketed(spark, rows: DataFrame, schema: str, keys: list[str]) -> BucketTable:
    out = BucketTable(spark, fresh_path(spark, "bucketed"), schema, keys, buckets=16)
    out.replace(rows)
    return out


@query(f"WITH {_UP} SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NULL THEN t.name ELSE s.name END AS name, CASE WHEN s.k IS NULL THEN t.serie ELSE s.serie END AS serie, CASE WHEN s.k IS NULL THEN t.bal ELSE s.bal END AS bal FROM t FULL JOIN s ON t.k = s.k")
def k02_bucketed_replace(spark, sf_dir):
    old, new = _upsert_frames(spark, sf_dir)
    stored = _bucketed(spark, old, _CUSTOMER, ["k"])
    stored.upsert(new)
    return stored.read()


@query(f"WITH {_UP} SELECT coalesce(s.k, t.k) AS k, CASE WHEN t.k IS NOT NULL THEN t.name ELSE s.name END AS name, CASE WHEN s.k IS NULL THEN t.serie WHEN t.k IS NULL THEN s.serie ELSE coalesce(nullif(trim(s.serie), ''), nullif(trim(t.serie), '')) END AS serie, CASE WHEN t.k IS NULL THEN s.bal ELSE coalesce(s.bal, t.bal) END AS bal FROM t FULL JOIN s ON t.k = s.k")
def k03_k05_bucketed_policies(spark, sf_dir):
    old, new = _upsert_frames(spark, sf_dir)
    stored = _bucketed(spark, old, _CUSTOMER, ["k"])
    stored.upsert(new, {"name": Policy.KEEP, "serie": Policy.COALESCE_TRIMMED, "bal": Policy.COALESCE})
    return stored.read()


@query(f"WITH {_UP} SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NULL THEN t.name ELSE s.name END AS name, CASE WHEN s.k IS NULL THEN t.serie WHEN t.k IS NULL THEN trim(s.serie) ELSE coalesce(nullif(trim(s.serie), ''), t.serie) END AS serie, CASE WHEN t.k IS NULL THEN s.bal ELSE coalesce(s.bal, t.bal) END AS bal FROM t FULL JOIN s ON t.k = s.k")
def k04_bucketed_nonempty(spark, sf_dir):
    old, new = _upsert_frames(spark, sf_dir)
    stored = _bucketed(spark, old, _CUSTOMER, ["k"])
    stored.upsert(new.withColumn("serie", F.trim("serie")), {"serie": Policy.COALESCE_NONEMPTY, "bal": Policy.COALESCE})
    return stored.read()


@query("SELECT event_id, event_type FROM events")
def k06_bucketed_insert(spark, sf_dir):
    """A third of the events, then all of them twice over."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    stored = _bucketed(spark, e.where("event_id % 3 = 0"), "event_id long, event_type string", ["event_id"])
    stored.insert_absent(e.unionByName(e.where("event_id % 5 = 0")))
    return stored.read()


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE CAST(o_totalprice AS DOUBLE) END AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def k10_bucketed_update(spark, sf_dir):
    """New prices for a third of the orders, some of them unknown; a seventh is removed."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    stored = _bucketed(spark, o, "o_orderkey long, o_orderstatus string, o_totalprice double", ["o_orderkey"])
    some = o.where("o_orderkey % 3 = 0")
    stored.update_from(some.unionByName(some.withColumn("o_orderkey", -F.col("o_orderkey") - 1)).select("o_orderkey", F.lit(1.0).alias("o_totalprice")), ["o_totalprice"])
    stored.remove(o.where("o_orderkey % 7 = 0"))
    return stored.read()


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 9.0 END AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS flag FROM orders")
def k11_bucketed_reset(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.lit(1).alias("flag"))
    stored = _bucketed(spark, o, "o_orderkey long, o_totalprice double, flag int", ["o_orderkey"])
    stored.reset_then_set(o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(9.0).alias("o_totalprice"), F.lit(1).alias("flag")), ["o_totalprice", "flag"], ("flag",))
    return stored.read()


@query(
    "SELECT 'days' AS part, o_orderkey, CAST(o_totalprice AS DOUBLE) AS o_totalprice FROM orders WHERE o_orderdate >= DATE '1998-01-01' AND o_orderdate < DATE '1998-07-01'"
    " UNION ALL SELECT 'key', o_orderkey, CAST(o_totalprice AS DOUBLE) FROM orders WHERE o_orderkey = (SELECT max(o_orderkey) FROM orders) UNION ALL SELECT 'text', o_orderkey, CAST(o_totalprice AS DOUBLE) FROM orders WHERE o_orderpriority = '2-HIGH' AND CAST(o_totalprice AS DOUBLE) > 100000 UNION ALL SELECT 'null', o_orderkey, NULL FROM orders WHERE o_orderkey % 10 = 0"
)
def s07_scan(spark, sf_dir):
    """A stored table, laid down in two loads, scanned by a range of days, by its key, by text and number, and by nulls."""
    o = table(spark, sf_dir, "orders")
    price = F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice").cast("double"))
    rows = o.select("o_orderkey", F.to_date("o_orderdate").alias("day"), "o_orderpriority", F.col("o_totalprice").cast("double").alias("full_price"), price.alias("o_totalprice"))
    old = F.col("day") < "1998-01-01"
    stored = _bucketed(spark, rows.where(old), "o_orderkey long, day date, o_orderpriority string, full_price double, o_totalprice double", ["o_orderkey"])
    stored.insert_absent(rows.where(~old))
    last = o.agg(F.max("o_orderkey")).first()[0]
    asked = {"days": [("day", ">=", "1998-01-01"), ("day", "<", "1998-07-01")], "key": [("o_orderkey", "=", last)], "text": [("o_orderpriority", "=", "2-HIGH"), ("full_price", ">", 100000)]}
    found = [stored.scan(*c).select(F.lit(part).alias("part"), "o_orderkey", F.col("full_price").alias("o_totalprice")) for part, c in asked.items()]
    found.append(stored.scan(("o_totalprice", "is", None)).select(F.lit("null").alias("part"), "o_orderkey", "o_totalprice"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


_VISITS = """seen AS (SELECT visitor_id_hash, occurred_at, CASE WHEN occurred_at - lag(occurred_at) OVER (PARTITION BY visitor_id_hash ORDER BY occurred_at) <= INTERVAL 36 HOUR THEN 0 ELSE 1 END AS fresh FROM v_events),
visits AS (SELECT *, sum(fresh) OVER (PARTITION BY visitor_id_hash ORDER BY occurred_at ROWS UNBOUNDED PRECEDING) AS visit FROM seen)"""


@query(
    cte("v_events", more=_VISITS)
    + """SELECT visitor_id_hash, min(occurred_at) AS first_seen_at, max(occurred_at) AS last_seen_at FROM visits
WHERE visit = (SELECT max(v.visit) FROM visits v WHERE v.visitor_id_hash = visits.visitor_id_hash) GROUP BY visitor_id_hash HAVING max(occurred_at) >= (SELECT max(occurred_at) - INTERVAL 36 HOUR FROM v_events)"""
)
def x03_visitor_state(spark, sf_dir):
    """All events as a stream of ten days a batch; visitors are forgotten after 36 hours, so most come back as new ones."""
    path, root = fresh_path(spark, "sightings"), fresh_path(spark, "visitors")
    rows = view(spark, sf_dir, "v_events").select("visitor_id_hash", "occurred_at")
    end = rows.agg(F.max("occurred_at")).first()[0]
    for k in range(3):  # files of their own, in order of time
        rows.where(F.floor(F.datediff(F.lit(end), "occurred_at") / 10) == 2 - k if k else F.datediff(F.lit(end), "occurred_at") >= 20).coalesce(1).write.mode("append").parquet(path)
    table_ = visitors.visitor_table(spark, f"{root}/table", buckets=8)
    source = spark.readStream.schema("visitor_id_hash string, occurred_at timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    visitors.track_visitors(source, table_, f"{root}/checkpoint", days=1.5)
    return visitors.known_since(table_, end - dt.timedelta(hours=36))


_SEARCHED = ["title", "preacher_name", "serie", "text_reference"]
_ASKED = ("Urgent", "e", "build%ing", "FRANCE 1", "er#0000000", "nowhere")
_FOUND = " OR ".join(f"lower(coalesce({c}, '')) LIKE '%' || lower(q) || '%'" for c in _SEARCHED)


@query(cte("v_gold") + f"SELECT q, canonical_sermon_id FROM v_gold, (VALUES {', '.join(f'({a!r})' for a in _ASKED)}) x(q) WHERE {_FOUND}")
def f05_search_postings(spark, sf_dir):
    """Questions through stored postings of the whole catalogue: frequent and rare parts, a single letter, a wildcard, nothing to find."""
    g = scratch_stored(view(spark, sf_dir, "v_gold").select("canonical_sermon_id", *_SEARCHED), "catalogue")  # postings and every question read it
    stored = grams.store_postings(g, "canonical_sermon_id", _SEARCHED, fresh_path(spark, "postings"))
    found = [grams.search_postings(g, "canonical_sermon_id", _SEARCHED, a, stored).select(F.lit(a).alias("q"), "canonical_sermon_id") for a in _ASKED]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def chained(ids: DataFrame) -> DataFrame:
    """Ids with a parent: every third in a chain from the root -1, every third behind a cycle, the others below ids that no table has."""
    parent = F.when(F.col("id") % 3 == 0, F.when(F.col("id") == 0, -1).otherwise(F.col("id") - 3)).when(F.col("id") % 3 == 1, F.when(F.col("id") == 1, 4).otherwise(F.col("id") - 3)).otherwise(-F.col("id"))
    root = ids.sparkSession.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("long").alias("parent"))
    return ids.withColumn("parent", parent).unionByName(root)


@query("SELECT p_partkey AS id, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey / 3 + 1 ELSE -1 END AS INTEGER) AS level FROM part WHERE p_partkey % 3 = 0")
def j17_long_chain(spark, sf_dir):
    """A chain through a third of all parts, beside a cycle and pages whose parents are missing."""
    return joins.descendants(chained(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))), "id", "parent", -1).where("level > 0")


@query(cte("v_events") + "SELECT event_id, occurred_at, event_type FROM v_events WHERE occurred_at >= TIMESTAMP '2024-01-11 06:00:00'")
def x02_x04_compacted_days(spark, sf_dir):
    """Batches, one of them sent again by another writer and dropped by its ids; closed days joined, a batch repeated after that, old days dropped."""
    now = dt.datetime(2024, 1, 31, 6)
    since = now - dt.timedelta(days=20)
    store = DayTable(spark, fresh_path(spark, "days"), "event_id string, occurred_at timestamp, event_type string", "occurred_at", ident="event_id")
    rows = view(spark, sf_dir, "v_events").select("event_id", "occurred_at", "event_type")
    part = lambda k: rows.where(F.col("event_id").cast("long") % 3 == k)
    for k in range(3):
        store.put(part(k), f"b{k}")
    sent_again = rows.where("CAST(event_id AS BIGINT) % 5 = 0")
    store.put(sent_again.join(store.stored_before(sent_again, dt.datetime(2000, 1, 1)), "event_id", "left_anti"), "other")
    store.compact(dt.date(2024, 1, 25))
    store.put(part(1), "b1")
    store.vacuum()
    store.expire(20, now)
    return store.read(since)


_NOW = dt.datetime(2024, 1, 20)
_ALL_RULES = """, g0 AS (SELECT * EXCLUDE (preaching_date), CAST(canonical_sermon_id AS INTEGER) AS n, CAST(CAST(preaching_date AS DATE) + INTERVAL 12 YEAR AS DATE) AS d FROM v_gold),
gold AS (SELECT *, n % 3 <> 0 AS has_path, n % 3 <> 0 AND n % 5 <> 0 AS there, CASE WHEN n % 3 <> 0 AND n % 7 <> 0 THEN duration_seconds / 60 END AS minutes FROM g0 WHERE day(d) >= 8),
lt AS (SELECT canonical_sermon_id, len(regexp_extract_all(transcript_text, '[^\\s]+')) AS words FROM (SELECT *, row_number() OVER (PARTITION BY canonical_sermon_id ORDER BY created_at DESC, transcript_version DESC) AS r FROM v_versions) WHERE r = 1),
wide AS (SELECT gold.*, words FROM gold LEFT JOIN lt USING (canonical_sermon_id)),
sundays AS (SELECT CAST(unnest(generate_series(DATE '2009-01-04', DATE '2024-01-14', INTERVAL 7 DAY)) AS DATE) AS d),
gaps AS (SELECT d, d IN (SELECT d FROM g0 WHERE day(d) < 8 AND month(d) % 2 = 0) AS excused FROM sundays WHERE d NOT IN (SELECT d FROM gold)),
runs AS (SELECT * FROM v_runs WHERE status = 'failed' OR calculated_at < TIMESTAMP '2024-01-10'),
m AS (
SELECT 'total_sermons' AS metric_key, count(*) AS value FROM wide
UNION ALL SELECT 'missing_mp3', count(*) FROM wide WHERE NOT has_path
UNION ALL SELECT 'mp3_file_missing', count(*) FROM wide WHERE has_path AND NOT there
UNION ALL SELECT 'mp3_without_transcript', count(*) FROM wide WHERE there AND words IS NULL
UNION ALL SELECT 'youtube_link', count(*) FROM wide WHERE coalesce(youtube_link, '') <> ''
UNION ALL SELECT 'wordpress_link', count(*) FROM wide WHERE coalesce(wordpress_link, '') <> ''
UNION ALL SELECT 'no_external_source', count(*) FROM wide WHERE coalesce(youtube_link, '') = '' AND coalesce(wordpress_link, '') = ''
UNION ALL SELECT 'missing_duration', count(*) FROM wide WHERE there AND minutes IS NULL
UNION ALL SELECT 'suspicious_duration', count(*) FROM wide WHERE minutes < 10 OR minutes > 150
UNION ALL SELECT 'missing_title', count(*) FROM wide WHERE trim(coalesce(title, '')) = ''
UNION ALL SELECT 'missing_preacher', count(*) FROM wide WHERE trim(coalesce(preacher_name, '')) = ''
UNION ALL SELECT 'missing_bible_reference', count(*) FROM wide WHERE n % 17 = 0
UNION ALL SELECT 'missing_series', count(*) FROM wide WHERE trim(coalesce(serie, '')) = ''
UNION ALL SELECT 'short_transcript', count(*) FROM wide WHERE words < 100
UNION ALL SELECT 'invalid_link', count(*) FROM wide WHERE youtube_link = 'youtube.com/x'
UNION ALL SELECT 'unreachable_link', count(*) FROM wide WHERE youtube_link = 'https://youtube.com/watch?v=x'
UNION ALL SELECT 'silver_missing_gold', count(*) FROM g0 WHERE n % 11 <> 0 AND day(d) < 8
UNION ALL SELECT 'orphan_media', count(*) FROM g0 WHERE n % 3 <> 0 AND n % 11 = 0
UNION ALL SELECT 'orphan_transcripts', count(*) FROM lt WHERE canonical_sermon_id NOT IN (SELECT canonical_sermon_id FROM g0 WHERE n % 11 <> 0)
UNION ALL SELECT 'possible_duplicates', count(*) FROM (SELECT d FROM gold GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT CASE WHEN excused THEN 'justified_missing_sundays' ELSE 'missing_sundays' END, count(*) FROM gaps GROUP BY 1
UNION ALL SELECT 'failed_pipeline_runs_7d', count(*) FROM runs WHERE status = 'failed' AND calculated_at >= TIMESTAMP '2024-01-13' AND calculated_at <= TIMESTAMP '2024-01-20'
UNION ALL SELECT 'stale_pipeline', CAST(max(calculated_at) FILTER (status = 'success') < TIMESTAMP '2024-01-12' AS INTEGER) FROM runs)
SELECT metric_key, value, CASE WHEN metric_key NOT IN ('silver_missing_gold', 'orphan_media', 'orphan_transcripts', 'possible_duplicates', 'missing_sundays', 'justified_missing_sundays', 'failed_pipeline_runs_7d', 'stale_pipeline') THEN (SELECT count(*) FROM wide) END AS denominator FROM m"""


def _all_rules(spark, sf_dir) -> dict[str, DataFrame]:
    """A catalogue that breaks every rule: talks of the first week of a month never reached gold, every second of these gaps is excused."""
    n, day = F.col("canonical_sermon_id").cast("int"), F.add_months(F.col("preaching_date").cast("date"), 144)
    all_ = view(spark, sf_dir, "v_gold").withColumns({"n": n, "d": day, "text_reference": F.when(n % 17 == 0, " ").otherwise(F.col("text_reference"))}).withColumn("preaching_date", F.col("d").cast("string"))
    early = F.day("d") < 8
    media = all_.where("n % 3 <> 0").select("canonical_sermon_id", F.lit("audio").alias("asset_type"), F.concat(F.lit("/m/"), "canonical_sermon_id").alias("local_path"), F.when(F.col("n") % 7 != 0, F.col("duration_seconds")).alias("duration_seconds"))
    return {
        "gold": all_.where(~early).drop("n", "d"),
        "metadata": all_.where("n % 11 <> 0").select("canonical_sermon_id", F.lit("youtube").alias("source_system"), F.col("canonical_sermon_id").alias("source_item_id"), "title", "preacher_name"),
        "media": media,
        "files": media.where("CAST(canonical_sermon_id AS INT) % 5 <> 0").select(F.col("local_path").alias("path"), F.lit(100).cast("long").alias("length")),
        "texts": view(spark, sf_dir, "v_versions"),
        "exceptions": all_.where(early & (F.month("d") % 2 == 0)).select("preaching_date", F.lit("feriado").alias("reason")).distinct(),
        "runs": view(spark, sf_dir, "v_runs").where("status = 'failed' OR calculated_at < TIMESTAMP '2024-01-10'"),
        "link_status": spark.createDataFrame([("https://youtube.com/watch?v=x", 404, "")], "url string, code int, error string"),
    }


@query(cte("v_gold", "v_versions", "v_runs") + _ALL_RULES)
def e12_all_rules(spark, sf_dir):
    return quality.quality_snapshot(_all_rules(spark, sf_dir), dt.date(2009, 1, 1), _NOW)[1]


@query(
    cte("v_gold")
    + """, g0 AS (SELECT *, CAST(canonical_sermon_id AS INTEGER) AS n, CAST(CAST(preaching_date AS DATE) + INTERVAL 12 YEAR AS DATE) AS d FROM v_gold), gold AS (SELECT * FROM g0 WHERE day(d) >= 8)
SELECT 'silver_missing_gold' AS metric_key, canonical_sermon_id AS entity_id, '' AS preaching_date, coalesce(title, '') AS title, coalesce(preacher_name, '') AS preacher_name, 'youtube' AS source_system, '' AS detail FROM g0 WHERE n % 11 <> 0 AND day(d) < 8
UNION ALL SELECT 'orphan_media', canonical_sermon_id, '', '', '', '', '/m/' || canonical_sermon_id FROM g0 WHERE n % 3 <> 0 AND n % 11 = 0
UNION ALL SELECT 'possible_duplicates', CAST(d AS VARCHAR), CAST(d AS VARCHAR), '', '', '', '["' || string_agg(canonical_sermon_id, '","' ORDER BY canonical_sermon_id) || '"]' FROM gold GROUP BY d HAVING count(*) > 1"""
)
def e12_set_issues(spark, sf_dir):
    """The issues of rules that compare tables, in full."""
    issues = quality.quality_snapshot(_all_rules(spark, sf_dir), dt.date(2009, 1, 1), _NOW)[0]
    return issues.where("metric_key IN ('silver_missing_gold', 'orphan_media', 'possible_duplicates')").select("metric_key", "entity_id", "preaching_date", "title", "preacher_name", "source_system", "detail")


_CELLS = "CASE p_partkey % 4 WHEN 0 THEN '=' || p_name WHEN 1 THEN '-' || p_name WHEN 2 THEN 'a \"b\", ' || p_name ELSE p_name END"


@query(
    f"""SELECT '2020-01-0' || (p_partkey % 9 + 1) AS preaching_date, CASE WHEN p_partkey % 4 < 2 THEN '''' ELSE '' END || {_CELLS} AS title, p_brand AS preacher_name, 'youtube' AS source_system, 'missing_title' AS metric_key, CAST(p_partkey AS VARCHAR) AS entity_id,
  CASE WHEN p_partkey % 5 = 0 THEN '' ELSE '''@' || p_type END AS detail, 'https://example.org/' || p_partkey AS link FROM part"""
)
def k16_export_csv(spark, sf_dir):
    """Issues written as CSV and read back: guarded cells, quotes and commas, missing details."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    title = F.when(n % 4 == 0, F.concat(F.lit("="), "p_name")).when(n % 4 == 1, F.concat(F.lit("-"), "p_name")).when(n % 4 == 2, F.concat(F.lit('a "b", '), "p_name")).otherwise(F.col("p_name"))
    issues = p.select(
        F.concat(F.lit("2020-01-0"), (n % 9 + 1).cast("string")).alias("preaching_date"), title.alias("title"), F.col("p_brand").alias("preacher_name"), F.lit("youtube").alias("source_system"), F.lit("missing_title").alias("metric_key"),
        n.cast("string").alias("entity_id"), F.when(n % 5 != 0, F.concat(F.lit("@"), "p_type")).alias("detail"), F.concat(F.lit("https://example.org/"), n.cast("string")).alias("link"),
    )
    path = fresh_path(spark, "csv")
    export_csv(issues, path)
    back = spark.read.option("header", True).schema(", ".join(f"{c} string" for c in CSV_COLUMNS)).csv(path)
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in CSV_COLUMNS])


@query("SELECT entity_id, CAST(row_number() OVER (ORDER BY preaching_date DESC NULLS LAST, lower(title), entity_id) AS BIGINT) AS place FROM (SELECT CAST(o_orderkey AS VARCHAR) AS entity_id, CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS preaching_date, CASE WHEN o_orderkey % 2 = 0 THEN upper(o_orderpriority) ELSE o_orderpriority END AS title FROM orders)")
def o06_issue_order(spark, sf_dir):
    """All issues with their place in the list; places are counted in the sorted partitions and moved by those before."""
    n = F.col("o_orderkey")
    issues = table(spark, sf_dir, "orders").select(n.cast("string").alias("entity_id"), F.when(n % 7 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("preaching_date"), F.when(n % 2 == 0, F.upper("o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("title"))
    return aggs.placed(aggs.order_issues(issues)).select("entity_id", "place")


@query("SELECT CAST(p_partkey AS VARCHAR) AS playlist_id, CAST(row_number() OVER (ORDER BY lower(title), CAST(p_partkey AS VARCHAR)) AS BIGINT) AS place FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Estudo ' || p_name WHEN 1 THEN 'CTB ' || p_name ELSE 'Culto ' || p_name END AS title FROM part) WHERE p_partkey % 3 <> 2")
def s11_playlists(spark, sf_dir):
    """Landed pages of playlists: the study ones, by folded title."""
    n = F.col("p_partkey")
    title = F.concat(F.when(n % 3 == 0, "Estudo ").when(n % 3 == 1, "CTB ").otherwise("Culto "), "p_name")
    item = F.struct(n.cast("string").alias("playlist_id"), title.alias("title"))
    pages = table(spark, sf_dir, "part").groupBy(F.floor(n / 50)).agg(F.collect_list(item).alias("items"))
    return aggs.placed(readers.flatten_pages(pages, "playlists")).select("playlist_id", "place")


@query("SELECT CAST(p_partkey AS VARCHAR) AS video_id, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS title, 'PT' || p_size || 'M' AS duration FROM part WHERE p_partkey % 4 <> 0")
def s11_details(spark, sf_dir):
    """Landed pages of video details; items without an id are dropped, a missing title is empty."""
    n = F.col("p_partkey")
    item = F.struct(F.when(n % 4 == 0, " ").otherwise(n.cast("string")).alias("video_id"), F.when(n % 5 != 0, F.col("p_name")).alias("title"), F.concat(F.lit("PT"), "p_size", F.lit("M")).alias("duration"))
    return readers.flatten_pages(table(spark, sf_dir, "part").groupBy(F.floor(n / 50)).agg(F.collect_list(item).alias("items")), "details")


@query(
    "WITH own AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'pdf' ELSE 'link' END AS kind, o_orderpriority AS label FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders))"
    " SELECT CAST(o_custkey AS VARCHAR) AS study_id, c_name AS title, id AS resource, kind, label FROM own, (SELECT min(o_custkey) AS o_custkey FROM orders) JOIN customer ON c_custkey = o_custkey"
)
def e17_study_detail(spark, sf_dir):
    """One study in full: its record and its resources by group."""
    o, n = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    kind = F.when(n % 3 == 0, "audio").when(n % 3 == 1, "pdf").otherwise("external_link")
    resources = o.select(F.col("o_custkey").cast("string").alias("study_id"), n.cast("int").alias("position"), F.concat("o_orderpriority", F.lit(" [0123456789ab]")).alias("label"), F.concat(F.lit("https://example.org/"), n).alias("canonical_url"), kind.alias("resource_type"), F.lit("").alias("mime_type"), F.lit("").alias("download_link"), F.lit(60.0).alias("duration_seconds"))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("study_id"), F.col("c_name").alias("title"))
    one = str(o.agg(F.min("o_custkey")).first()[0])
    detail = serving.study_detail(known, resources, one).select("study_id", "title", F.explode("groups").alias("g")).select("study_id", "title", "g.grp", F.explode("g.items").alias("i"))
    shown = F.create_map(*[F.lit(v) for v in ("audio", "audio", "documents", "pdf", "external_link", "link")])
    return detail.select("study_id", "title", F.col("i.position").cast("long").alias("resource"), F.coalesce(shown[F.col("grp")], F.col("grp")).alias("kind"), F.col("i.label").alias("label"))

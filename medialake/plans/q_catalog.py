"""Queries over the catalogue: picking, survivorship, counts, joins, upserts, quality."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from medialake.bindings import cte, table, view
from medialake.functions import text as x
from medialake.functions import times as t
from medialake.functions.text import book_name
from medialake.operators import aggs, filters, joins, pick
from medialake.plans import quality, serving
from medialake.plans.registry import query
from medialake.sources import readers
from medialake.sources import tables as k
from medialake.sources.scratch import fresh_path

_GOLD = cte("v_gold")


def gold(spark, sf_dir):
    return view(spark, sf_dir, "v_gold")


def meta(spark, sf_dir):
    return view(spark, sf_dir, "v_metadata")


@query(cte("v_versions") + "SELECT canonical_sermon_id, transcript_version, created_at, model_name FROM (SELECT *, row_number() OVER (PARTITION BY canonical_sermon_id ORDER BY created_at DESC, transcript_version DESC) AS r FROM v_versions) WHERE r = 1")
def w01_latest(spark, sf_dir):
    return pick.latest(view(spark, sf_dir, "v_versions"), ["canonical_sermon_id"], ["created_at", "transcript_version"]).select("canonical_sermon_id", "transcript_version", "created_at", "model_name")


_BEST = "ORDER BY (duration NOT IN ('', 'P0D')) DESC, published_at DESC, has_playlists DESC, video_id DESC"


@query(cte("v_candidates") + f"SELECT preaching_date, video_id, duration FROM (SELECT *, row_number() OVER (PARTITION BY preaching_date {_BEST}) AS r FROM v_candidates) WHERE r = 1")
def w02_best_candidate(spark, sf_dir):
    return pick.best_candidate(view(spark, sf_dir, "v_candidates")).select("preaching_date", "video_id", "duration")


@query(cte("v_candidates") + "SELECT preaching_date, min_by(nullif(duration, ''), struct_pack(a := video_id <> w, b := video_id)) FILTER (duration <> '') AS duration FROM (SELECT *, max(video_id) OVER (PARTITION BY preaching_date) AS w FROM v_candidates) GROUP BY 1")
def w03_fill_from_group(spark, sf_dir):
    c = view(spark, sf_dir, "v_candidates")
    win = c.groupBy("preaching_date").agg(F.max("video_id").alias("w"))
    return pick.fill_from_group(c.join(win, "preaching_date"), "preaching_date", ["duration"], F.col("video_id") == F.col("w"), "video_id")


_PRIO = "CASE source_system WHEN 'wordpress' THEN 0 ELSE 1 END"
_SCORE = "(CASE WHEN coalesce(title, '') <> '' THEN 1 ELSE 0 END + CASE WHEN coalesce(preacher_name, '') = '' THEN 0 WHEN lower(trim(preacher_name)) = 'nome sobrenome' THEN -10 ELSE 1 END + CASE WHEN coalesce(serie, '') <> '' THEN 1 ELSE 0 END)"


def _ranked(spark, sf_dir):
    m = meta(spark, sf_dir)
    return m.withColumns({"prio": F.when(F.col("source_system") == "wordpress", 0).otherwise(1), "score": pick.quality_score("title", "preacher_name", "serie")})


_ORDER = ["prio", "score", "processed_at", "source_item_id"]


def _order():
    return [F.col("prio"), -F.col("score"), F.col("processed_at"), F.col("source_item_id")]


def _first(c):
    return f"""(SELECT canonical_sermon_id, {c} FROM (SELECT *, row_number() OVER (PARTITION BY canonical_sermon_id ORDER BY prio, score DESC, processed_at, source_item_id) AS r FROM ranked
  WHERE trim(coalesce({c}, '')) <> '' AND lower(trim({c})) <> 'nome sobrenome') WHERE r = 1)"""


@query(
    cte("v_metadata", more=f"ranked AS (SELECT *, {_PRIO} AS prio, {_SCORE} AS score FROM v_metadata)")
    + f"SELECT k.canonical_sermon_id, t.title, p.preacher_name, s.serie FROM (SELECT DISTINCT canonical_sermon_id FROM ranked) k LEFT JOIN {_first('title')} t USING (canonical_sermon_id) LEFT JOIN {_first('preacher_name')} p USING (canonical_sermon_id) LEFT JOIN {_first('serie')} s USING (canonical_sermon_id)"
)
def w05_survivorship(spark, sf_dir):
    return pick.survivorship(_ranked(spark, sf_dir), "canonical_sermon_id", ["title", "preacher_name", "serie"], _order())


@query(cte("v_metadata") + f"SELECT source_item_id, {_SCORE} AS score FROM v_metadata")
def w06_quality_score(spark, sf_dir):
    return _ranked(spark, sf_dir).select("source_item_id", "score")


@query(cte("v_metadata") + f"SELECT canonical_sermon_id, source_item_id FROM (SELECT *, row_number() OVER (PARTITION BY canonical_sermon_id ORDER BY {_PRIO}, processed_at, source_item_id) AS r FROM v_metadata) WHERE r = 1")
def w07_preferred(spark, sf_dir):
    return pick.preferred(_ranked(spark, sf_dir), "canonical_sermon_id", [F.col("prio"), F.col("processed_at"), F.col("source_item_id")]).select("canonical_sermon_id", "source_item_id")


@query(
    cte("v_metadata")
    + f"""SELECT m.canonical_sermon_id, first.source_item_id, m.sources FROM (SELECT canonical_sermon_id, string_agg(DISTINCT source_system, ', ' ORDER BY source_system) AS sources FROM v_metadata GROUP BY 1) m
JOIN (SELECT canonical_sermon_id, source_item_id, row_number() OVER (PARTITION BY canonical_sermon_id ORDER BY {_PRIO}, source_item_id) AS r FROM v_metadata) first ON first.r = 1 AND first.canonical_sermon_id = m.canonical_sermon_id"""
)
def w08_dedupe_merge_sources(spark, sf_dir):
    rows = _ranked(spark, sf_dir).select("canonical_sermon_id", "source_item_id", "source_system", "prio")
    return pick.dedupe_merge_sources(rows, ["canonical_sermon_id"], [F.col("prio"), F.col("source_item_id")]).select("canonical_sermon_id", "source_item_id", "sources")


@query(
    """SELECT g, u, position FROM (SELECT l_suppkey AS g, l_partkey % 50 AS u, l_orderkey * 10 + l_linenumber AS position, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50
  ORDER BY l_linenumber > 3, CASE WHEN l_linenumber > 3 THEN l_orderkey * 10 + l_linenumber ELSE -(l_orderkey * 10 + l_linenumber) END) AS r FROM lineitem) WHERE r = 1"""
)
def w09_dedupe_links(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_partkey") % 50).alias("u"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), (F.col("l_linenumber") > 3).alias("is_raw"))
    return pick.dedupe_links(rows, ["g", "u"]).select("g", "u", "position")


@query("SELECT o_custkey, min_by(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def w10_first_by(spark, sf_dir):
    return pick.first_by(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("SELECT conv_id, role, CAST(min(p) AS INTEGER) AS position FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) GROUP BY 1, 2")
def w11_explode_dedupe(spark, sf_dir):
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("items"))
    return pick.explode_dedupe(lists, "items", "role").select("conv_id", "role", "position")


@query(
    cte("v_candidates", more="own AS (SELECT *, CASE WHEN duration IN ('', 'P0D') THEN 0.0 ELSE CAST(regexp_extract(duration, '([0-9]+)H', 1) AS DOUBLE) * 3600 + CAST(regexp_extract(duration, '([0-9]+)M', 1) AS DOUBLE) * 60 END AS s FROM v_candidates WHERE CAST(timezone('America/Sao_Paulo', timezone('UTC', published_at)) AS DATE) = DATE '1998-03-10')")
    + """SELECT count(*) AS n_videos, max_by(video_id, struct_pack(a := published_at, b := video_id)) AS latest_id, max_by(video_id, struct_pack(a := s, b := published_at, c := video_id)) FILTER (has_playlists) AS talk_id,
  coalesce(max(s) FILTER (has_playlists), 0.0) AS talk_seconds FROM own"""
)
def w12_day_report(spark, sf_dir):
    return pick.day_report(view(spark, sf_dir, "v_candidates").withColumn("is_talk", F.col("has_playlists")), "1998-03-10")


@query(
    cte("v_candidates", more="own AS (SELECT *, CASE WHEN duration IN ('', 'P0D') THEN 0.0 ELSE CAST(regexp_extract(duration, '([0-9]+)H', 1) AS DOUBLE) * 3600 + CAST(regexp_extract(duration, '([0-9]+)M', 1) AS DOUBLE) * 60 END AS s FROM v_candidates WHERE CAST(timezone('America/Sao_Paulo', timezone('UTC', published_at)) AS DATE) = DATE '1998-03-10')")
    + """SELECT count(*) AS n_videos, max_by(video_id, struct_pack(a := published_at, b := video_id)) AS latest_id, max_by(video_id, struct_pack(a := s, b := published_at, c := video_id)) FILTER (has_playlists) AS talk_id,
  coalesce(max(s) FILTER (has_playlists), 0.0) AS talk_seconds, count(*) > 0 AS latest_found, count(*) FILTER (has_playlists) > 0 AS talk_found, '1998-03-10' AS date FROM own"""
)
def e19_day_cut_report(spark, sf_dir):
    return serving.day_cut_report(view(spark, sf_dir, "v_candidates").withColumn("is_talk", F.col("has_playlists")), "1998-03-10")


@query(
    cte("v_metadata")
    + """SELECT source_item_id, CASE WHEN n > 1 THEN source_system || ' ' || substr(processed_at, 1, 4) ELSE source_system END AS label
FROM v_metadata LEFT JOIN (SELECT canonical_sermon_id, source_system, count(*) AS n FROM v_metadata WHERE trim(title) <> '' GROUP BY 1, 2) USING (canonical_sermon_id, source_system)"""
)
def w13_label_with_year(spark, sf_dir):
    return pick.label_with_year(meta(spark, sf_dir), "canonical_sermon_id", "source_system", "title", "processed_at").select("source_item_id", "label")


@query(_GOLD + "SELECT count(*) AS total, count(DISTINCT nullif(preacher_name, '')) AS preachers, count(DISTINCT nullif(serie, '')) AS series FROM v_gold")
def a01_catalog_stats(spark, sf_dir):
    return aggs.catalog_stats(gold(spark, sf_dir))


@query("SELECT (SELECT count(*) FROM part) AS studies, (SELECT count(*) FROM supplier) AS resources")
def a02_side_by_side(spark, sf_dir):
    return aggs.side_by_side(studies=table(spark, sf_dir, "part"), resources=table(spark, sf_dir, "supplier"))


@query(_GOLD + "SELECT max(preaching_date) AS last_update FROM v_gold")
def a03_last_update(spark, sf_dir):
    return aggs.last_update(gold(spark, sf_dir), "preaching_date")


@query(_GOLD + "SELECT serie, count(*) AS total FROM v_gold WHERE trim(coalesce(serie, '')) <> '' GROUP BY 1")
def a04_count_by_series(spark, sf_dir):
    return aggs.count_by(gold(spark, sf_dir), "serie")


@query(_GOLD + "SELECT serie, title, count(*) AS total FROM v_gold WHERE trim(coalesce(serie, '')) <> '' AND trim(coalesce(title, '')) <> '' GROUP BY 1, 2")
def a05_count_by_two(spark, sf_dir):
    return aggs.count_by(gold(spark, sf_dir), "serie", "title")


@query(_GOLD + "SELECT split_part(trim(text_reference), ' ', 1) AS book, count(*) AS total, 66 AS position FROM v_gold GROUP BY 1")
def a06_count_books(spark, sf_dir):
    return aggs.count_books(gold(spark, sf_dir))


@query(_GOLD + "SELECT substr(preaching_date, 1, 4) AS year, count(*) AS total FROM v_gold GROUP BY 1")
def a07_count_years(spark, sf_dir):
    return aggs.count_years(gold(spark, sf_dir))


@query(
    _GOLD
    + """, c AS (SELECT count(*) FILTER (serie = 'BUILDING') AS o, count(*) FILTER (serie = 'MACHINERY') AS n, count(*) AS total FROM v_gold), s AS (SELECT *, coalesce(round_even(o * 100.0 / nullif(o + n, 0), 0), 0.0) AS p FROM c)
SELECT o AS old, n AS new, total - o - n AS unclassified, p AS old_percent, CASE WHEN o + n > 0 THEN 100.0 - p ELSE 0.0 END AS new_percent FROM s"""
)
def a08_two_class_share(spark, sf_dir):
    ref = F.when(F.col("serie") == "BUILDING", "Gn 1").when(F.col("serie") == "MACHINERY", "Mt 1").otherwise("?")
    return aggs.two_class_share(gold(spark, sf_dir).withColumn("text_reference", ref))


@query(
    _GOLD
    + """, cats AS (SELECT * FROM (VALUES (0, 'BUILDING'), (1, 'NONE'), (2, 'MACHINERY')) v(position, serie)), c AS (SELECT position, serie, (SELECT count(*) FROM v_gold g WHERE g.serie = cats.serie) AS total FROM cats)
SELECT position, serie, total, coalesce(round_even(total * 100.0 / nullif(max(total) OVER (), 0), 0), 0.0) AS percent FROM c"""
)
def a09_category_share(spark, sf_dir):
    return aggs.category_share(gold(spark, sf_dir), "serie", ["BUILDING", "NONE", "MACHINERY"])


@query("SELECT l_orderkey, max(l_shipdate) FILTER (l_returnflag = 'R') AS returned, max(l_shipdate) FILTER (l_returnflag = 'N') AS shipped FROM lineitem GROUP BY 1 HAVING max(l_quantity) > 45")
def a10_pivot_max(spark, sf_dir):
    is_ = lambda f: (F.col("l_returnflag") == f, F.col("l_shipdate"))
    return aggs.pivot_max(table(spark, sf_dir, "lineitem"), "l_orderkey", {"returned": is_("R"), "shipped": is_("N"), "q": (F.lit(True), F.col("l_quantity"))}, F.col("q") > 45).drop("q")


@query(cte("v_metadata") + "SELECT canonical_sermon_id, string_agg(DISTINCT source_system, ', ' ORDER BY source_system) AS sources FROM v_metadata GROUP BY 1")
def a17_source_list(spark, sf_dir):
    return aggs.source_list(meta(spark, sf_dir), "canonical_sermon_id")


@query(_GOLD + "SELECT preaching_date, '[\"' || string_agg(canonical_sermon_id, '\",\"' ORDER BY canonical_sermon_id) || '\"]' AS ids, count(*) AS n FROM v_gold GROUP BY 1 HAVING count(*) > 1")
def a18_duplicate_keys(spark, sf_dir):
    return aggs.duplicate_keys(gold(spark, sf_dir), "preaching_date", "canonical_sermon_id")


@query("SELECT 'toxic' AS metric_key, (SELECT count(*) FROM labels WHERE toxic = 1) AS value, (SELECT count(*) FROM documents) AS denominator UNION ALL SELECT 'none', 0, NULL")
def a19_metric_rows(spark, sf_dir):
    issues = table(spark, sf_dir, "labels").where("toxic = 1").select(F.lit("toxic").alias("metric_key"))
    return aggs.metric_rows(issues, [("toxic", True), ("none", False)], table(spark, sf_dir, "documents"))


@query("SELECT p_partkey AS study_id, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS resource_count FROM part")
def a20_resource_counts(spark, sf_dir):
    return aggs.resource_counts(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("study_id")), table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("study_id")))


@query("SELECT o_custkey, min(nullif(CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE strftime(o_orderdate, '%Y-%m-%d') END, '')) AS date, min_by(o_orderpriority, struct_pack(a := CAST(o_orderpriority[1] AS INTEGER), b := o_orderpriority)) AS kind FROM orders GROUP BY 1")
def a21_group_min(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.col("o_orderpriority").alias("kind"))
    return aggs.group_min(o, "o_custkey", "date", "kind", F.substring("kind", 1, 1).try_cast("int"))


@query(cte("v_metadata") + "SELECT DISTINCT 'source' AS facet, source_system AS value FROM v_metadata UNION SELECT 'year', substr(processed_at, 1, 4) FROM v_metadata UNION SELECT 'speaker', preacher_name FROM v_metadata WHERE preacher_name <> ''")
def a22_facets(spark, sf_dir):
    return aggs.facets(meta(spark, sf_dir).withColumnRenamed("processed_at", "preaching_date"))


@query("SELECT count(*) AS eligible, count(*) FILTER (o_orderkey % 3 <> 0) AS downloaded, count(*) FILTER (o_orderkey % 3 = 0) AS missing_files, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0) AS missing_durations, count(*) FILTER (o_orderkey % 3 <> 0 AND o_orderkey % 2 = 0) AS missing_transcripts FROM orders")
def a23_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("resource_id"))
    assets = o.where("resource_id % 3 <> 0").select("resource_id", F.col("resource_id").alias("asset_id"), F.concat(F.lit("/f/"), "resource_id").alias("path"), F.when(F.col("resource_id") % 5 != 0, 60.0).alias("duration_seconds"), (F.col("resource_id") % 2 != 0).alias("has_text"))
    files = assets.select("path", F.lit(10).cast("long").alias("length"))
    return aggs.coverage(joins.reconcile(o, assets, files))


@query("SELECT event_type, count(*) AS total FROM events GROUP BY 1")
def a24_count_required(spark, sf_dir):
    return aggs.count_required(table(spark, sf_dir, "events"), "event_type", ["view", "click"])


@query("SELECT n_regionkey AS region, CAST(len(list(n_name)) AS INTEGER) AS n, string_agg(n_name, ',' ORDER BY n_name[1], n_name) AS names FROM nation GROUP BY 1")
def a25_nest(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.substring("n_name", 1, 1).alias("letter"), "n_name")
    nested = aggs.nest(n, "region", "letter", F.col("n_name"))
    flat = F.flatten(F.transform("groups", lambda g: g["items"]))
    return nested.select("region", F.size(flat).alias("n"), F.array_join(flat, ",").alias("names"))


@query(_GOLD + "SELECT canonical_sermon_id, preaching_date FROM v_gold ORDER BY preaching_date DESC, canonical_sermon_id LIMIT 20")
def o01_newest(spark, sf_dir):
    return aggs.newest(gold(spark, sf_dir), 20).select("canonical_sermon_id", "preaching_date")


@query(_GOLD + "SELECT canonical_sermon_id FROM v_gold ORDER BY CASE title WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END, preaching_date DESC, canonical_sermon_id LIMIT 50")
def o04_enum_order(spark, sf_dir):
    return aggs.order_by_enum(gold(spark, sf_dir), "title", ["1-URGENT", "3-MEDIUM"], F.desc("preaching_date"), F.asc("canonical_sermon_id")).select("canonical_sermon_id").limit(50)


@query(_GOLD + "SELECT canonical_sermon_id FROM v_gold WHERE preaching_date >= '2001-06-01'")
def f01_date_scope(spark, sf_dir):
    return filters.date_scope(gold(spark, sf_dir), "preaching_date", 30, today=dt.date(2001, 7, 1)).select("canonical_sermon_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderdate >= TIMESTAMP '2001-06-01'")
def f02_recent(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("at", F.when(F.col("o_orderkey") % 4 == 0, "?").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")))
    return filters.recent(o, "at", 30, dt.datetime(2001, 7, 1)).select("o_orderkey")


_SP = "CAST(timezone('America/Sao_Paulo', timezone('UTC', {})) AS DATE)"


@query(f"SELECT DISTINCT l_orderkey FROM lineitem WHERE {_SP.format('l_shipdate')} BETWEEN DATE '1998-03-08' AND DATE '1998-03-12' OR (l_linenumber = 1 AND {_SP.format('l_shipdate + INTERVAL 40 DAY')} BETWEEN DATE '1998-03-08' AND DATE '1998-03-12')")
def f03_date_window(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("published_at"), F.when(F.col("l_linenumber") == 1, F.date_format(F.col("l_shipdate") + F.expr("INTERVAL 40 DAYS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("live"))
    return filters.date_window(li, ["published_at", "live"], "1998-03-10", 2, t.ZONE, "l_orderkey").select("l_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1999-12-31' AND o_orderstatus IN ('O') AND o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0")
def f04_published(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("post_date"), F.when(F.col("o_orderstatus") == "O", "publish").otherwise("draft").alias("status"), F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("a"), F.lit("talks"))).otherwise(F.array(F.lit("a"))).alias("categories"), F.when(F.col("o_orderkey") % 5 == 0, "por Nome Sobrenome").otherwise("x").alias("content"))
    return filters.published(o, "1999-12-31", "talks").select("o_orderkey")


@query(_GOLD + "SELECT canonical_sermon_id FROM v_gold WHERE lower(coalesce(title, '')) LIKE '%urgent%' OR lower(coalesce(preacher_name, '')) LIKE '%urgent%' OR lower(coalesce(serie, '')) LIKE '%urgent%' OR lower(coalesce(text_reference, '')) LIKE '%urgent%'")
def f05_search(spark, sf_dir):
    return filters.search(gold(spark, sf_dir), ["title", "preacher_name", "serie", "text_reference"], "Urgent").select("canonical_sermon_id")


@query(_GOLD + "SELECT 'year' AS mode, canonical_sermon_id FROM v_gold WHERE preaching_date LIKE '1999%' UNION ALL SELECT 'serie', canonical_sermon_id FROM v_gold WHERE serie = 'BUILDING' UNION ALL SELECT 'book', canonical_sermon_id FROM v_gold WHERE split_part(trim(text_reference), ' ', 1) = (SELECT min(split_part(n_name, ' ', 1)) FROM nation)")
def f06_lookup(spark, sf_dir):
    g = gold(spark, sf_dir)
    first = table(spark, sf_dir, "nation").agg(F.min(book_name("n_name"))).first()[0]
    found = {"year": filters.lookup(g, "preaching_date", "1999", "prefix"), "serie": filters.lookup(g, "serie", "BUILDING"), "book": filters.lookup(g, "text_reference", first, "book")}
    return joins.union_tagged({m: d.select("canonical_sermon_id") for m, d in found.items()}, "mode")


@query(cte("v_metadata") + "SELECT source_item_id FROM v_metadata WHERE processed_at LIKE '2024%' AND source_system LIKE '%tube%'")
def f07_filter_issues(spark, sf_dir):
    return filters.filter_issues(meta(spark, sf_dir).withColumnRenamed("processed_at", "preaching_date"), year="2024", source="tube").select("source_item_id")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice <= 65536 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def f11_admit(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.ceil("o_totalprice").alias("content_length"), F.when(F.col("o_orderkey") % 5 == 0, "Mozilla GoogleBot/2").otherwise("Mozilla").alias("user_agent"), F.when(F.col("o_orderkey") % 7 == 0, "https://else.example").when(F.col("o_orderkey") % 2 == 0, "https://Example.org").otherwise("").alias("origin"), F.lit("example.org").alias("host"))
    return filters.admit(o).select("o_orderkey")


@query(cte("v_events") + "SELECT event_id, event_type, page_path, CASE WHEN listened_seconds IS NOT NULL THEN least(listened_seconds, 60.0) END AS listened_seconds, 'ref.example.org' AS referrer_domain FROM v_events WHERE event_type IN ('page_view', 'youtube_click') OR content_type <> ''")
def f12_validate_events(spark, sf_dir):
    raw = view(spark, sf_dir, "v_events").withColumns({"resource_id": F.lit(None).cast("string"), "position_seconds": F.lit("x"), "duration_seconds": F.lit("10"), "referrer": F.lit("https://Ref.example.org:8080/p?q")})
    return filters.validate_events(raw).select("event_id", "event_type", "page_path", "listened_seconds", "referrer_domain")


@query("SELECT p_partkey, p_partkey % 3 <> 2 AS is_mp3 FROM part")
def f13_is_mp3(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", filters.is_mp3(F.when(F.col("p_partkey") % 3 == 0, "Audio/MPEG"), F.when(F.col("p_partkey") % 3 == 1, "/a/B.MP3").otherwise("/a/b.wav")).alias("is_mp3"))


@query(_GOLD + "SELECT preaching_date, count(*) AS n FROM v_gold WHERE preaching_date = (SELECT max(preaching_date) FROM v_gold WHERE preaching_date < '2000') GROUP BY 1")
def f14_f10_target(spark, sf_dir):
    g = gold(spark, sf_dir).where("preaching_date < '2000'")
    date = filters.target(g).first()["preaching_date"]
    return filters.target(g, date).groupBy("preaching_date").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def j01_with_parent(spark, sf_dir):
    return joins.with_parent(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, sf_dir, "customer"), "c_custkey").select("o_orderkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, p_name, s_name, v.turn AS version FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN (SELECT conv_id, max(turn) AS turn FROM conversations GROUP BY 1) v ON s_suppkey = v.conv_id")
def j02_resource_text(spark, sf_dir):
    res = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("study_id"), F.col("l_suppkey").alias("resource_id"))
    studies = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("study_id"), "p_name")
    assets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("resource_id"), F.col("s_suppkey").alias("asset_id"), "s_name")
    texts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("asset_id"), F.col("turn").alias("transcript_version"))
    return joins.resource_text(res, studies, assets, texts).select("l_orderkey", "l_linenumber", "p_name", "s_name", F.col("transcript_version").alias("version"))


@query("SELECT s_suppkey, max(c_name) AS last FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey AND c_acctbal > 0 GROUP BY 1")
def j03_assets_with_date(spark, sf_dir):
    m = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("preaching_date"))
    return joins.assets_with_date(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")), m, "k").select(F.col("k").alias("s_suppkey"), F.col("preaching_date").alias("last"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def j04_pending(spark, sf_dir):
    return joins.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 1 ELSE 0 END AS labelled FROM documents d")
def j05_exists_flag(spark, sf_dir):
    return joins.exists_flag(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "labelled")


@query("SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_returnflag <> 'R' OR NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_orderkey = l.l_orderkey AND o.l_returnflag = 'A')")
def j06_unless_sibling(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return joins.unless_sibling(li, "l_orderkey", F.col("l_returnflag") == "A", F.col("l_returnflag") == "R").select("l_orderkey", "l_linenumber")


@query("SELECT CAST(o_custkey AS VARCHAR) AS k FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def j07_orphans(spark, sf_dir):
    child = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("k"))
    return joins.orphans(child, table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("k")), "k")


@query(cte("v_metadata") + "SELECT canonical_sermon_id, min(source_item_id) AS source_item_id, string_agg(DISTINCT source_system, ', ' ORDER BY source_system) AS sources FROM v_metadata WHERE CAST(canonical_sermon_id AS INTEGER) % 3 <> 0 GROUP BY 1")
def j08_missing_downstream(spark, sf_dir):
    m = meta(spark, sf_dir)
    return joins.missing_downstream(m, m.where("CAST(canonical_sermon_id AS INT) % 3 = 0"), "canonical_sermon_id", ["source_item_id"]).select("canonical_sermon_id", "source_item_id", "sources")


@query("SELECT p_partkey AS video_id, coalesce((SELECT string_agg(DISTINCT s_name, ',' ORDER BY s_name) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_partkey = p_partkey), '') AS playlists FROM part")
def j10_memberships(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("video_id"), F.col("s_name").alias("playlist_title"))
    return joins.attach_memberships(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id")), items).select("video_id", F.array_join("playlists", ",").alias("playlists"))


@query("SELECT p_partkey AS video_id, coalesce(s_name, p_name) AS title, s_acctbal AS view_count FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def j11_merge_details(spark, sf_dir):
    videos = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id"), F.col("p_name").alias("title"))
    details = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("video_id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("view_count"))
    return joins.merge_details(videos, details)


@query("SELECT p_partkey, CASE WHEN s_suppkey IS NULL OR s_suppkey % 2 = 0 THEN p_name ELSE s_name END AS label, s_suppkey IS NOT NULL AND s_suppkey % 2 = 1 AS replaced FROM part LEFT JOIN supplier ON p_partkey = s_suppkey")
def j12_replace_titles(spark, sf_dir):
    res = table(spark, sf_dir, "part").select("p_partkey", F.lit("video").alias("kind"), F.col("p_partkey").cast("string").alias("ref_id"), F.col("p_name").alias("label"))
    names = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "part"), F.col("s_suppkey") == F.col("p_partkey")).select(F.lit("video").alias("kind"), F.col("s_suppkey").cast("string").alias("ref_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("p_name")).otherwise(F.col("s_name")).alias("title"))
    return joins.replace_titles(res, names).select("p_partkey", "label", "replaced")


@query(cte("v_titles") + "SELECT p_partkey, CASE WHEN p_partkey % 4 = 2 THEN 'romanos' END AS book FROM v_titles")
def j13_t10_match_books(spark, sf_dir):
    from medialake.functions.text import CANON, fold

    books = spark.createDataFrame([(i, b, b) for i, b in enumerate(CANON)], "position int, folded string, book string")
    ts = view(spark, sf_dir, "v_titles").select("p_partkey", fold("title").alias("folded_title"))
    return joins.match_books(ts, books, "p_partkey", "folded_title").select("p_partkey", "book")


@query("SELECT page_id, CASE WHEN page_id % 3 = 2 THEN NULL ELSE CAST(page_id AS VARCHAR) END AS target FROM pages")
def j15_j16_resolve_links(spark, sf_dir):
    ident = F.col("page_id").cast("string")
    p = table(spark, sf_dir, "pages").select("page_id", ident.alias("post_id"), F.concat(F.lit("https://example.org/p/"), ident, F.lit("/")).alias("link"))
    links = p.select("page_id", F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://example.org/?page_id="), ident)).when(F.col("page_id") % 3 == 1, F.concat(F.lit("https://www.example.org/p/"), ident, F.lit("#x"))).otherwise("https://example.org/none").alias("url"))
    found = joins.resolve_links(links.withColumnRenamed("page_id", "source_id"), p.select("post_id", "link"))
    return found.select(F.col("source_id").alias("page_id"), F.col("page_id").alias("target"))


@query("SELECT conv_id * 100 + turn AS id, CAST(turn AS INTEGER) AS level FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations)")
def j17_descendants(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.when(F.col("turn") > 0, F.col("conv_id") * 100 + F.col("turn") - 1).alias("parent"))
    root = table(spark, sf_dir, "conversations").agg(F.min("conv_id")).first()[0] * 100
    return joins.descendants(c, "id", "parent", root)


@query("SELECT l_orderkey, l_linenumber, 's' || l_suppkey AS study_id FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def j18_reparent(spark, sf_dir):
    kids = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("study_key"))
    return joins.reparent(kids, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("study_key"), F.concat(F.lit("s"), "s_suppkey").alias("study_id")))


@query("SELECT 's' AS tag, s_name AS name FROM supplier UNION ALL SELECT 'c', c_name FROM customer")
def ua_union_tagged(spark, sf_dir):
    return joins.union_tagged({"s": table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name")), "c": table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))}, "tag")


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def ub_key_diff(spark, sf_dir):
    return joins.key_diff(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


@query("SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def ud_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1")
def ue_require_values(spark, sf_dir):
    return joins.require_values(table(spark, sf_dir, "nation"), "n_regionkey", ["0", "1"]).groupBy("n_regionkey").agg(F.count("*").alias("n"))


_SUNDAYS = """CAST(unnest(generate_series(DATE '1999-01-03', DATE '2002-12-29', INTERVAL 7 DAY)) AS DATE)"""


@query(
    _GOLD
    + f"""SELECT CAST(day AS VARCHAR) AS day, day = DATE '2002-07-07' AS justified FROM (SELECT {_SUNDAYS} AS day) s WHERE NOT EXISTS (SELECT 1 FROM v_gold WHERE preaching_date = CAST(day AS VARCHAR)) OR day = DATE '2002-07-07' AND NOT EXISTS (SELECT 1 FROM v_gold WHERE preaching_date = '2002-07-07')"""
)
def ts3_j14_missing_sundays(spark, sf_dir):
    last = dt.date(2002, 12, 31)
    own = gold(spark, sf_dir)
    why = spark.createDataFrame([("2002-07-07", "feriado")], "preaching_date string, reason string")
    spine = t.days_between(spark, dt.date(1999, 1, 3), last - dt.timedelta(days=2), 7)
    gaps = joins.calendar_gaps(spine, own.select(F.col("preaching_date").cast("date").alias("day")), why.select(F.col("preaching_date").cast("date").alias("day"), "reason"))
    return gaps.select(F.col("day").cast("string").alias("day"), F.col("reason").isNotNull().alias("justified"))


_UP = "t AS (SELECT c_custkey AS k, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS serie, c_acctbal AS bal FROM customer WHERE c_custkey % 3 <> 0), s AS (SELECT c_custkey AS k, upper(c_name) AS name, CASE WHEN c_custkey % 5 = 0 THEN ' new ' ELSE ' ' END AS serie, CASE WHEN c_custkey % 4 = 0 THEN -1.0 END AS bal FROM customer WHERE c_custkey % 4 <> 1)"


def _upsert_frames(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    t_ = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("serie"), F.col("c_acctbal").alias("bal"))
    s_ = c.where("c_custkey % 4 <> 1").select(F.col("c_custkey").alias("k"), F.upper("c_name").alias("name"), F.when(F.col("c_custkey") % 5 == 0, " new ").otherwise(" ").alias("serie"), F.when(F.col("c_custkey") % 4 == 0, -1.0).alias("bal"))
    return t_, s_


@query(f"WITH {_UP} SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NULL THEN t.name ELSE s.name END AS name, CASE WHEN s.k IS NULL THEN t.serie ELSE s.serie END AS serie, CASE WHEN s.k IS NULL THEN t.bal ELSE s.bal END AS bal FROM t FULL JOIN s ON t.k = s.k")
def k02_upsert_replace(spark, sf_dir):
    return k.upsert(*_upsert_frames(spark, sf_dir), ["k"])


@query(f"WITH {_UP} SELECT coalesce(s.k, t.k) AS k, CASE WHEN t.k IS NOT NULL THEN t.name ELSE s.name END AS name, CASE WHEN s.k IS NULL THEN t.serie WHEN t.k IS NULL THEN s.serie ELSE coalesce(nullif(trim(s.serie), ''), nullif(trim(t.serie), '')) END AS serie, CASE WHEN t.k IS NULL THEN s.bal ELSE coalesce(s.bal, t.bal) END AS bal FROM t FULL JOIN s ON t.k = s.k")
def k03_k05_upsert_policies(spark, sf_dir):
    return k.upsert(*_upsert_frames(spark, sf_dir), ["k"], {"name": k.Policy.KEEP, "serie": k.Policy.COALESCE_TRIMMED, "bal": k.Policy.COALESCE})


@query(f"WITH {_UP} SELECT coalesce(s.k, t.k) AS k, CASE WHEN s.k IS NULL THEN t.name ELSE s.name END AS name, CASE WHEN s.k IS NULL THEN t.serie WHEN t.k IS NULL THEN trim(s.serie) ELSE coalesce(nullif(trim(s.serie), ''), t.serie) END AS serie, CASE WHEN t.k IS NULL THEN s.bal ELSE coalesce(s.bal, t.bal) END AS bal FROM t FULL JOIN s ON t.k = s.k")
def k04_upsert_nonempty(spark, sf_dir):
    t_, s_ = _upsert_frames(spark, sf_dir)
    return k.upsert(t_, s_.withColumn("serie", F.trim("serie")), ["k"], {"serie": k.Policy.COALESCE_NONEMPTY, "bal": k.Policy.COALESCE})


@query("SELECT p_partkey, CASE WHEN kind = 'audio' OR mp3 THEN 'audio' WHEN kind IN ('pdf', 'word') THEN 'documents' ELSE kind END AS grp FROM (SELECT p_partkey, ['audio', 'pdf', 'word', 'youtube', 'link'][p_partkey % 5 + 1] AS kind, p_partkey % 3 = 0 AS mp3 FROM part)")
def t51_resource_group(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("audio", "pdf", "word", "youtube", "link"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), F.lit("").alias("mime"), F.when(F.col("p_partkey") % 3 == 0, "/media/a.mp3").when(F.col("p_partkey") % 3 == 1, "/media/a.pdf").alias("link"))
    return p.select("p_partkey", filters.resource_group("kind", "mime", "link").alias("grp"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Centro de Treinamento Bíblico' WHEN 1 THEN 'Estudos Semanais' WHEN 2 THEN 'other' ELSE '' END AS label, CAST(CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 4 END AS INTEGER) AS place, CASE WHEN p_partkey % 3 = 0 THEN 'Documentos' ELSE 'Links externos' END AS grp FROM part")
def t50_labels(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("ctb"), F.lit("weekly"), F.lit("other"), F.lit(None)), (F.col("p_partkey") % 4 + 1).cast("int"))
    p = table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"), filters.resource_group(F.when(F.col("p_partkey") % 3 == 0, "archive"), F.lit(""), F.lit("")).alias("grp"))
    return p.select("p_partkey", x.label_of("kind", x.STUDY_TYPES).alias("label"), x.place_of("kind", x.STUDY_TYPES).alias("place"), x.label_of("grp", x.RESOURCE_GROUPS).alias("grp"))


@query("SELECT (row_number() OVER (ORDER BY user_id) - 1) // 50 AS batch, user_id FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)")
def o07_batches(spark, sf_dir):
    return joins.batches(table(spark, sf_dir, "events"), "user_id").select("batch", F.explode("ids").alias("user_id"))


@query("SELECT conv_id, CAST(turn AS VARCHAR) AS video_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS position FROM (SELECT DISTINCT conv_id, turn FROM conversations) WHERE turn % 3 <> 0")
def s10_memberships(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    item = F.struct("turn", F.when(F.col("turn") % 3 == 0, " ").otherwise(F.col("turn").cast("string")).alias("video_id"))
    pages = c.groupBy(F.col("conv_id").alias("playlist_id"), F.floor(F.col("turn") / 2).alias("page")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return readers.memberships(pages).select(F.col("playlist_id").alias("conv_id"), "video_id", "position")


@query("SELECT CAST(p_partkey AS VARCHAR) AS ref_id, p_brand AS kind, p_name AS title FROM part WHERE p_partkey % 4 <> 0")
def s11_flatten_titles(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    item = F.struct(F.col("p_brand").alias("kind"), F.col("p_partkey").cast("string").alias("ref_id"), F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.concat(F.lit(" "), "p_name")).alias("title"))
    return readers.flatten_pages(p.groupBy(F.floor(F.col("p_partkey") / 50)).agg(F.collect_list(item).alias("items")), "titles")


@query("SELECT lower(p_name) || ' ' || p_partkey AS alias, p_type AS name FROM part")
def s06_alias_dimension(spark, sf_dir):
    path = fresh_path(spark, "alias")
    p = table(spark, sf_dir, "part")
    p.select(F.concat(F.lit("  "), F.upper("p_name"), F.lit(" "), "p_partkey", F.lit(': "'), "p_type", F.lit('"')).alias("value")).write.text(path)
    return readers.load_alias_dim(spark, path)


@query("SELECT p_partkey, p_name AS title, '<p>' || p_brand || '</p>' AS content, CASE WHEN p_partkey % 2 = 0 THEN 'page' ELSE 'attachment' END AS post_type, '' AS mime_type FROM part")
def s04_site_export(spark, sf_dir):
    path = fresh_path(spark, "export")
    kind = F.when(F.col("p_partkey") % 2 == 0, "page").otherwise("attachment")
    cell = lambda tag, value: F.concat(F.lit(f"<{tag}>"), value, F.lit(f"</{tag}>"))
    content = F.concat(F.lit("<![CDATA[<p>"), "p_brand", F.lit("</p>]]>"))
    items = F.concat(F.lit("<item>"), cell("title", F.col("p_name")), cell("content:encoded", content), cell("wp:post_id", F.col("p_partkey").cast("string")), cell("wp:post_type", kind), F.lit("</item>"))
    head, tail = '<rss xmlns:wp="w" xmlns:content="c"><channel>', "</channel></rss>"
    documents = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 1000)).agg(F.concat(F.lit(head), F.array_join(F.collect_list(items), ""), F.lit(tail)).alias("value"))
    documents.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return readers.read_wxr_pages(spark, path).select(F.col("post_id").cast("long").alias("p_partkey"), "title", "content", "post_type", "mime_type")


@query("SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new' ELSE c_name END AS name FROM customer")
def k09_replace_partial(spark, sf_dir):
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    return k.replace_partial(old, old.where("k % 2 = 0").withColumn("name", F.lit("new")), "k", complete=False)


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE o_totalprice END AS o_totalprice FROM orders")
def k10_update_from(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return k.update_from(o, o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(1.0).alias("o_totalprice")), ["o_orderkey"], ["o_totalprice"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 9.0 END AS o_totalprice, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS flag FROM orders")
def k11_reset_then_set(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("flag"))
    return k.reset_then_set(o, o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit(9.0).alias("o_totalprice"), F.lit(1).alias("flag")), ["o_orderkey"], ["o_totalprice", "flag"], ("flag",))


@query(_GOLD + "SELECT canonical_sermon_id, nullif(trim(serie), '') AS serie FROM v_gold")
def k12_blank_to_null(spark, sf_dir):
    return k.blank_to_null_table(gold(spark, sf_dir).select("canonical_sermon_id", "serie"), "serie")


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS version, text FROM conversations")
def k14_append_version(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    old = c.where("turn < 2").select("conv_id", (F.col("turn") + 1).cast("int").alias("version"), "text")
    return k.append_version(old, c.where("turn >= 2").select("conv_id", "turn", "text"), "conv_id", "version", ["turn"])


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 6 = 0 THEN 'x' END, o_orderpriority) AS o_orderpriority FROM orders")
def k18_backfill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    old = o.where("o_orderkey % 3 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "x").alias("o_orderpriority"))
    return k.backfill(o, old.unionByName(old), ["o_orderkey"], ["o_orderpriority"])


@query("SELECT 'good' AS side, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 0 UNION ALL SELECT 'bad', count(*) FROM orders WHERE o_orderkey % 10 = 0")
def k19_split_errors(spark, sf_dir):
    good, bad = k.split_errors(table(spark, sf_dir, "orders").withColumn("error", F.when(F.col("o_orderkey") % 10 == 0, "timeout")))
    count = lambda d, n: d.agg(F.lit(n).alias("side"), F.count("*").alias("n"))
    return count(good, "good").unionByName(count(bad, "bad"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '''=' || p_name WHEN 1 THEN '''-' || p_name ELSE p_name END AS cell FROM part")
def k16_csv_guard(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("v", F.concat(F.when(F.col("p_partkey") % 3 == 0, "=").when(F.col("p_partkey") % 3 == 1, "-").otherwise(""), "p_name"))
    return p.select("p_partkey", k.guarded("v").alias("cell"))


def _quality_tables(spark, sf_dir):
    g = gold(spark, sf_dir)
    media = g.where("CAST(canonical_sermon_id AS INT) % 3 <> 0").select("canonical_sermon_id", F.lit("audio").alias("asset_type"), F.concat(F.lit("/m/"), "canonical_sermon_id").alias("local_path"), F.when(F.expr("CAST(canonical_sermon_id AS INT) % 7 <> 0"), F.col("duration_seconds")).alias("duration_seconds"))
    files = media.where("CAST(canonical_sermon_id AS INT) % 5 <> 0").select(F.col("local_path").alias("path"), F.lit(100).cast("long").alias("length"))
    status = spark.createDataFrame([("https://youtube.com/watch?v=x", 404, "")], "url string, code int, error string")
    return {"gold": g, "metadata": g.where("CAST(canonical_sermon_id AS INT) % 11 <> 0").select("canonical_sermon_id", F.lit("youtube").alias("source_system"), F.col("canonical_sermon_id").alias("source_item_id"), "title", "preacher_name"), "media": media, "files": files, "texts": view(spark, sf_dir, "v_versions"), "exceptions": spark.createDataFrame([("1999-07-04", "feriado")], "preaching_date string, reason string"), "runs": view(spark, sf_dir, "v_runs"), "link_status": status}


_QUALITY = """, w AS (SELECT *, CAST(canonical_sermon_id AS INTEGER) AS n, n % 3 <> 0 AS has_path, n % 3 <> 0 AND n % 5 <> 0 AS there, CASE WHEN n % 3 <> 0 AND n % 7 <> 0 THEN duration_seconds / 60 END AS minutes FROM v_gold),
lt AS (SELECT canonical_sermon_id, len(regexp_extract_all(transcript_text, '[^\\s]+')) AS words FROM (SELECT *, row_number() OVER (PARTITION BY canonical_sermon_id ORDER BY created_at DESC, transcript_version DESC) AS r FROM v_versions) WHERE r = 1),
wide AS (SELECT w.*, words FROM w LEFT JOIN lt USING (canonical_sermon_id)),
sundays AS (SELECT CAST(unnest(generate_series(DATE '2009-01-04', DATE '2009-01-04', INTERVAL 7 DAY)) AS DATE) AS day),
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
UNION ALL SELECT 'missing_bible_reference', count(*) FROM wide WHERE trim(coalesce(text_reference, '')) = ''
UNION ALL SELECT 'missing_series', count(*) FROM wide WHERE trim(coalesce(serie, '')) = ''
UNION ALL SELECT 'short_transcript', count(*) FROM wide WHERE words < 100
UNION ALL SELECT 'invalid_link', count(*) FROM wide WHERE youtube_link = 'youtube.com/x'
UNION ALL SELECT 'unreachable_link', count(*) FROM wide WHERE youtube_link = 'https://youtube.com/watch?v=x'
UNION ALL SELECT 'silver_missing_gold', 0
UNION ALL SELECT 'orphan_media', count(*) FROM wide WHERE has_path AND n % 11 = 0
UNION ALL SELECT 'orphan_transcripts', count(*) FROM lt WHERE canonical_sermon_id NOT IN (SELECT canonical_sermon_id FROM wide WHERE n % 11 <> 0)
UNION ALL SELECT 'possible_duplicates', count(*) FROM (SELECT preaching_date FROM wide GROUP BY 1 HAVING count(DISTINCT canonical_sermon_id) > 1)
UNION ALL SELECT 'missing_sundays', 0
UNION ALL SELECT 'justified_missing_sundays', 0
UNION ALL SELECT 'failed_pipeline_runs_7d', count(*) FROM v_runs WHERE status = 'failed' AND calculated_at >= TIMESTAMP '2024-01-13' AND calculated_at <= TIMESTAMP '2024-01-20'
UNION ALL SELECT 'stale_pipeline', CASE WHEN max(calculated_at) FILTER (status = 'success') < TIMESTAMP '2024-01-12' THEN 1 ELSE 0 END FROM v_runs)
SELECT metric_key, CASE WHEN metric_key = 'missing_sundays' THEN (SELECT count(*) FROM (SELECT unnest(generate_series(DATE '2009-01-04', DATE '2024-01-14', INTERVAL 7 DAY)))) ELSE value END AS value,
  CASE WHEN metric_key NOT IN ('silver_missing_gold', 'orphan_media', 'orphan_transcripts', 'possible_duplicates', 'missing_sundays', 'justified_missing_sundays', 'failed_pipeline_runs_7d', 'stale_pipeline') THEN (SELECT count(*) FROM wide) END AS denominator FROM m"""


@query(cte("v_gold", "v_versions", "v_runs") + _QUALITY)
def e12_quality_metrics(spark, sf_dir):
    return quality.quality_snapshot(_quality_tables(spark, sf_dir), dt.date(2009, 1, 1), dt.datetime(2024, 1, 20))[1]


@query(cte("v_gold") + "SELECT canonical_sermon_id AS entity_id, 'youtube_link' AS detail FROM v_gold WHERE youtube_link = 'youtube.com/x'")
def e12_invalid_links(spark, sf_dir):
    q = _quality_tables(spark, sf_dir)
    wide = quality.wide_catalog(q["gold"], q["metadata"], q["media"], q["files"], q["texts"])
    return quality.row_issues(wide, quality.Limits()).where("metric_key = 'invalid_link'").select("entity_id", "detail")

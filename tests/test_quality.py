"""The quality snapshot: every rule fires on a catalogue made to break them, and tables meet once."""

import datetime as dt

from pyspark.sql import functions as F

from medialake.plans import q_tables, quality


def test_every_rule_fires(spark, sf_small):
    metrics = {r.metric_key: r.value for r in q_tables.e12_all_rules(spark, sf_small).collect()}
    assert set(metrics) == dict(quality.RULES).keys() and min(metrics.values()) > 0


def test_tables_are_exchanged_once(spark, sf_small):
    t = q_tables._all_rules(spark, sf_small)
    plain = {k: spark.createDataFrame(v.limit(50).toPandas(), v.schema) for k, v in t.items() if k in ("gold", "metadata", "media", "files", "texts")}
    states = quality.talk_states(plain["gold"], plain["metadata"], plain["media"], plain["files"], plain["texts"])
    plan = states._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(canonical_sermon_id") == 1 and plan.count("Exchange") <= 3


def test_states_of_odd_tables(spark):
    gold = spark.createDataFrame([("a", "2024-01-07", "T", None, None, None, None, None)], "canonical_sermon_id string, preaching_date string, title string, preacher_name string, serie string, text_reference string, youtube_link string, wordpress_link string")
    meta = spark.createDataFrame([("b", "y", "2", "t2", "p2"), ("b", "w", "1", "t1", None), ("b", None, "0", "t0", None), (" ", "y", "9", "", "")], "canonical_sermon_id string, source_system string, source_item_id string, title string, preacher_name string")
    media = spark.createDataFrame([("c", "audio", "/x", 1.0), ("c", "video", None, None), (None, "audio", "/n", None)], "canonical_sermon_id string, asset_type string, local_path string, duration_seconds double")
    files = spark.createDataFrame([("/x", 5)], "path string, length long")
    texts = spark.createDataFrame([("d", dt.datetime(2024, 1, 1), 1, "one two"), ("d", dt.datetime(2024, 1, 2), 1, "one"), ("d", dt.datetime(2024, 1, 2), 2, None)], "canonical_sermon_id string, created_at timestamp, transcript_version int, transcript_text string")
    got = {r.canonical_sermon_id: r for r in quality.talk_states(gold, meta, media, files, texts).collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    assert got["b"].sources == "w, y" and got["b"].m.title == "t0" and got["b"].n_gold == 0 and got["c"].length == 5 and got["d"].words == 0 and got["a"].n_gold == 1
    issues = {(r.metric_key, r.entity_id, r.detail) for r in quality.set_issues(quality.talk_states(gold, meta, media, files, texts)).collect()}
    assert issues == {("silver_missing_gold", "b", ""), ("orphan_media", "c", "/x"), ("orphan_transcripts", "d", "")}


def test_one_address_of_many_talks_is_not_sorted(spark):
    """Links stream past the failed ones; talks with the same address do not gather in a sorted run."""
    wide = spark.range(200).select(F.col("id").cast("string").alias("canonical_sermon_id"), F.lit("d").alias("preaching_date"), F.lit("t").alias("title"), F.lit("p").alias("preacher_name"), F.lit("s").alias("source_system"), F.lit("https://youtu.be/x").alias("youtube_link"), *[F.lit(None).cast("string").alias(c) for c in quality.LINKS[1:]])
    wide = spark.createDataFrame(wide.collect(), wide.schema)  # of unknown size, so nothing is broadcast
    found = quality.unreachable(wide, spark.createDataFrame([("https://youtu.be/x", 404, ""), ("https://youtu.be/y", 500, "")], "url string, code int, error string"), quality.Limits())
    assert "Sort [url" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(int(r.entity_id) for r in found.collect()) == list(range(200))


def test_tasks_aggregate_a_bounded_number_of_rows(spark, monkeypatch):
    """Above the bound, talks are dealt into parts whose number follows the rows; a file listed twice doubles no talk."""
    monkeypatch.setattr(quality, "TASK_ROWS", 20)
    ids = spark.range(300).select(F.col("id").cast("string").alias("canonical_sermon_id"))
    gold = ids.select("*", F.lit("2024-01-07").alias("preaching_date"), *[F.lit("x").alias(c) for c in ("title", "preacher_name", "serie", "text_reference", "youtube_link", "wordpress_link")])
    meta = ids.select("*", F.lit("y").alias("source_system"), F.col("canonical_sermon_id").alias("source_item_id"), F.lit("t").alias("title"), F.lit("p").alias("preacher_name"))
    media = ids.select("*", F.lit("audio").alias("asset_type"), F.concat(F.lit("/"), "canonical_sermon_id").alias("local_path"), F.lit(1.0).alias("duration_seconds"))
    files = media.select(F.col("local_path").alias("path"), F.lit(5).cast("long").alias("length"))
    texts = spark.createDataFrame([], "canonical_sermon_id string, created_at timestamp, transcript_version int, transcript_text string")
    states = quality.talk_states(gold, meta, media, files.unionByName(files.limit(10)), texts)
    assert states.rdd.getNumPartitions() == 900 // 20
    got = states.collect()
    assert len(got) == 300 and all((r.n_gold, r.n_meta, r.n_media, r.length) == (1, 1, 1, 5) for r in got)

"""Aggregations and rankings; all combine map-side and are ordered in full."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions.text import book_name, book_position, is_blank, testament, text
from medialake.functions.times import local_date, pct
from medialake.sources.scratch import stored

PLAY, DONE, LOAD, PROGRESS = "audio_play", "audio_complete", "download", "audio_progress"


def _is(kind: str) -> Column:
    return F.col("event_type") == kind


def catalog_stats(df: DataFrame) -> DataFrame:
    distinct = lambda c: F.countDistinct(F.nullif(F.col(c), F.lit("")))
    return df.agg(F.count("*").alias("total"), distinct("preacher_name").alias("preachers"), distinct("serie").alias("series"))


def side_by_side(**frames: DataFrame) -> DataFrame:
    """Row counts of several frames in one row."""
    counts = [df.agg(F.count("*").alias(name)) for name, df in frames.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.crossJoin(one)  # one row beside one row
    return out


def last_update(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias("last_update"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Counts of filled keys, most first, then by name."""
    rows = df
    for k in keys:
        rows = rows.where(~is_blank(k))
    return rows.groupBy(*keys).agg(F.count("*").alias("total")).orderBy(F.desc("total"), *[F.lower(k) for k in keys], *keys)


def count_books(df: DataFrame, reference: str = "text_reference") -> DataFrame:
    """Counts by book in canon order; references without a book, or of digits alone, are left out."""
    named = df.select(book_name(reference).alias("book")).where("book <> '' AND NOT book RLIKE '^[0-9]+$'")
    return named.groupBy("book").agg(F.count("*").alias("total")).withColumn("position", book_position("book")).orderBy("position", "book")


def count_years(df: DataFrame, date: str = "preaching_date") -> DataFrame:
    year = F.substring(text(date), 1, 4)
    return df.where(year.rlike(r"^\d{4}$")).groupBy(year.alias("year")).agg(F.count("*").alias("total")).orderBy(F.desc("year"))


def two_class_share(df: DataFrame, reference: str = "text_reference") -> DataFrame:
    """Talks of either testament with shares that add up to 100, and the unclassified rest."""
    kind = testament(reference)
    row = df.agg(F.count_if(kind == "old").alias("old"), F.count_if(kind == "new").alias("new"), F.count("*").alias("n"))
    known = F.col("old") + F.col("new")
    share = F.coalesce(F.bround(F.col("old") * 100.0 / F.nullif(known, F.lit(0)), 0), F.lit(0.0))
    return row.select("old", "new", (F.col("n") - known).alias("unclassified"), share.alias("old_percent"), F.when(known > 0, 100.0 - share).otherwise(0.0).alias("new_percent"))


def category_share(df: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """Counts over a fixed list of categories, zeros included, with percent of the largest."""
    fixed = df.sparkSession.createDataFrame(list(enumerate(categories)), f"position int, {key} string")
    counted = fixed.join(df.groupBy(key).agg(F.count("*").alias("total")), key, "left").select("position", key, F.coalesce("total", F.lit(0)).alias("total"))
    top = counted.agg(F.max("total").alias("top"))
    return counted.crossJoin(top).select("position", key, "total", pct(F.col("total"), F.col("top"), 0).alias("percent"))


def pivot_max(df: DataFrame, key: str, conditions: dict[str, tuple[Column, Column]], having: Column) -> DataFrame:
    """Per key, the largest value under each condition."""
    return df.groupBy(key).agg(*[F.max(F.when(test, value)).alias(name) for name, (test, value) in conditions.items()]).where(having)


def content_stats(events: DataFrame) -> DataFrame:
    """Plays, listeners, completions, downloads and listened time per content."""
    rows = events.where("content_type <> '' AND content_id <> ''").groupBy("content_type", "content_id")
    out = rows.agg(
        F.count_if(_is(PLAY)).alias("plays"),
        F.countDistinct(F.when(_is(PLAY), F.col("visitor_id_hash"))).alias("listeners"),
        F.count_if(_is(DONE)).alias("completions"),
        F.count_if(_is(LOAD)).alias("downloads"),
        F.coalesce(F.sum(F.when(_is(PROGRESS), F.col("listened_seconds"))), F.lit(0.0)).alias("seconds"),
    )
    return out.withColumns({"completion_rate": pct(F.col("completions"), F.col("plays")), "hours": F.bround(F.col("seconds") / 3600, 1)})


def visitor_split(events: DataFrame, visitors: DataFrame, start: dt.date, tz: str) -> DataFrame:
    """Visitors of a period that were first seen in it, and the others; unknown ones count as returning."""
    own = events.select("visitor_id_hash").distinct().join(visitors.select("visitor_id_hash", "first_seen_at"), "visitor_id_hash", "left")
    new = F.coalesce(local_date("first_seen_at", tz) >= F.lit(start), F.lit(False))
    return own.agg(F.count_if(new).alias("new_visitors"), F.count_if(~new).alias("returning_visitors"))


def kpis(events: DataFrame, visitors: DataFrame, start: dt.date, tz: str, content_type: str = "") -> DataFrame:
    """The measures of a period in one row; a content type narrows all but views, visitors and clicks."""
    own = F.lit(True) if not content_type else F.col("content_type") == content_type
    count = lambda kind: F.count_if(_is(kind) & own)
    one = events.agg(
        F.count_if(_is("page_view")).alias("page_views"),
        F.countDistinct("visitor_id_hash").alias("visitors"),
        count(PLAY).alias("plays"),
        F.countDistinct(F.when(_is(PLAY) & own, F.struct("visitor_id_hash", "content_type", "content_id"))).alias("unique_plays"),
        count(DONE).alias("completions"),
        count(LOAD).alias("downloads"),
        F.coalesce(F.sum(F.when(_is(PROGRESS) & own, F.col("listened_seconds"))), F.lit(0.0)).alias("listened_seconds"),
        F.coalesce(F.sum(F.when(own, F.col("bytes_estimated"))), F.lit(0)).alias("bytes"),
        F.count_if(_is("youtube_click")).alias("youtube_clicks"),
    )
    return one.crossJoin(visitor_split(events, visitors, start, tz)).withColumn("completion_rate", pct(F.col("completions"), F.col("plays")))


def plays_by_dims(events: DataFrame, talks: DataFrame) -> DataFrame:
    """Plays by speaker, series and book: ``dimension, name, plays``; counted by talk before the join."""
    played = events.where(_is(PLAY) & (F.col("content_type") == "sermon")).groupBy("content_id").agg(F.count("*").alias("n"))
    named = played.join(talks.select(F.col("canonical_sermon_id").alias("content_id"), "preacher_name", "serie", "text_reference"), "content_id")
    dims = F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("name")) for d, v in (("speaker", text("preacher_name")), ("serie", text("serie")), ("book", book_name("text_reference")))])
    return named.select("n", F.inline(dims)).where("name <> ''").groupBy("dimension", "name").agg(F.sum("n").alias("plays"))


def seconds_by_rate(events: DataFrame) -> DataFrame:
    rate = F.coalesce(F.nullif(F.col("playback_rate"), F.lit(0.0)), F.lit(1.0))
    return events.where(_is(PROGRESS)).groupBy(rate.alias("rate")).agg(F.sum(F.coalesce("listened_seconds", F.lit(0.0))).alias("seconds")).orderBy(F.desc("seconds"), "rate")


def clicks_by_type(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").endswith("_click")).groupBy("event_type").agg(F.count("*").alias("clicks"))


def source_list(df: DataFrame, key: str, source: str = "source_system", separator: str = ", ") -> DataFrame:
    return df.where(~is_blank(source)).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(source)), separator).alias("sources"))


def duplicate_keys(df: DataFrame, key: str, ident: str, unique: bool = False) -> DataFrame:
    """Keys with several ids, as a sorted JSON list. Ids are made distinct first, unless they are, so a key's set holds ids, not rows."""
    rows = df.select(key, ident) if unique else df.select(key, ident).distinct()
    return rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(ident))).alias("ids"), F.count("*").alias("n")).where("n > 1")


def metric_rows(issues: DataFrame, rules: list[tuple[str, bool]], total: DataFrame) -> DataFrame:
    """Issue counts over a fixed list of ``(rule, has a denominator)``, zeros included."""
    fixed = issues.sparkSession.createDataFrame(rules, "metric_key string, counted boolean")
    counted = fixed.join(issues.groupBy("metric_key").agg(F.count("*").alias("value")), "metric_key", "left")
    n = total.agg(F.count("*").alias("total"))
    return counted.crossJoin(n).select("metric_key", F.coalesce("value", F.lit(0)).alias("value"), F.when(F.col("counted"), F.col("total")).alias("denominator"))


def resource_counts(studies: DataFrame, resources: DataFrame, key: str = "study_id") -> DataFrame:
    return studies.join(resources.groupBy(key).agg(F.count("*").alias("resource_count")), key, "left").withColumn("resource_count", F.coalesce("resource_count", F.lit(0)))


def group_min(df: DataFrame, key: str, date: str, kind: str, priority: Column) -> DataFrame:
    return df.groupBy(key).agg(F.min(F.nullif(F.col(date), F.lit(""))).alias(date), F.min_by(kind, F.struct(priority, F.col(kind))).alias(kind))


def facets(issues: DataFrame) -> DataFrame:
    """Years, single sources and speakers to filter by: ``facet, value``."""
    values = F.concat(
        F.array(F.struct(F.lit("year").alias("facet"), F.substring(text("preaching_date"), 1, 4).alias("value")), F.struct(F.lit("speaker").alias("facet"), text("preacher_name").alias("value"))),
        F.transform(F.split(text("source_system"), r",\s*"), lambda s: F.struct(F.lit("source").alias("facet"), s.alias("value"))),
    )
    return issues.select(F.inline(values)).where("value <> ''").distinct()


def coverage(state: DataFrame) -> DataFrame:
    """How far enrichment went, over ``asset_id, path, length, duration_seconds, has_text`` of eligible resources."""
    there = F.col("asset_id").isNotNull() & F.col("length").isNotNull()
    return state.agg(
        F.count("*").alias("eligible"),
        F.count_if(there).alias("downloaded"),
        F.count_if(~there).alias("missing_files"),
        F.count_if(there & F.col("duration_seconds").isNull()).alias("missing_durations"),
        F.count_if(there & ~F.coalesce("has_text", F.lit(False))).alias("missing_transcripts"),
    )


def count_required(df: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Counts by type; raises where a required type is absent."""
    counts = df.groupBy(key).agg(F.count("*").alias("total"))
    wanted = df.sparkSession.createDataFrame([(r,) for r in required], f"{key} string")
    absent = [r[0] for r in wanted.join(counts, key, "left_anti").collect()]  # at most the required list
    if absent:
        raise ValueError(f"types without rows: {sorted(absent)}")
    return counts


def nest(df: DataFrame, outer: str, inner: str, item: Column, name: str = "items") -> DataFrame:
    """Rows as a nested structure: per outer key, inner keys with their sorted items."""
    groups = df.groupBy(outer, inner).agg(F.array_sort(F.collect_list(item)).alias(name))
    return groups.groupBy(outer).agg(F.array_sort(F.collect_list(F.struct(inner, name))).alias("groups"))


def freshness(runs: DataFrame, now: dt.datetime) -> DataFrame:
    """Failures of the last seven days, and whether the last success is over eight days old."""
    good = F.max(F.when(F.col("status") == "success", F.col("calculated_at")))
    return runs.agg(
        F.count_if((F.col("status") == "failed") & (F.col("calculated_at") >= F.lit(now - dt.timedelta(days=7))) & (F.col("calculated_at") <= F.lit(now))).alias("failed_7d"),
        F.coalesce(good < F.lit(now - dt.timedelta(days=8)), F.lit(True)).alias("stale"),
    )


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def newest(df: DataFrame, n: int, date: str = "preaching_date", tie: str = "canonical_sermon_id") -> DataFrame:
    return top_k(df, [F.desc_nulls_last(date), F.asc(tie)], n)


def order_by_enum(df: DataFrame, column: str, values: list[str], *more: Column) -> DataFrame:
    place = F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(column)), F.lit(0))
    return df.orderBy(F.when(place == 0, len(values) + 1).otherwise(place), *more)


def order_issues(issues: DataFrame) -> DataFrame:
    """Issues from the newest on, undated ones last; on one day by title in any case, then by entity."""
    return issues.orderBy(F.desc_nulls_last("preaching_date"), F.lower(text("title")), "entity_id")


def placed(ordered: DataFrame) -> DataFrame:
    """An ordered frame with every row's ``place`` from 1, counted within the sorted ranges and moved by what the ranges before hold."""
    rows = stored(ordered.withColumn("at", F.monotonically_increasing_id()), "placed")
    part, within = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", before.alias("base"))  # a row a range
    return rows.withColumn("part", part).join(base, "part").withColumn("place", F.col("base") + within + 1).drop("at", "part", "base")


def tail(df: DataFrame, n: int, ts: str, tie: str) -> DataFrame:
    """The last ``n`` rows, oldest first."""
    return df.orderBy(F.desc(ts), F.desc(tie)).limit(n).orderBy(ts, tie)

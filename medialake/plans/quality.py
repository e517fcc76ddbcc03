"""The data-quality snapshot: one pass over the wide catalogue, set rules and the calendar beside it."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions.text import is_blank, text, word_count
from medialake.functions.times import missing_weekdays
from medialake.functions.urls import is_checkable, is_valid_link
from medialake.operators import aggs
from medialake.sources.scratch import stored

#: Rules with whether their share of all talks is meaningful (fixed values).
RULES = [
    ("total_sermons", True), ("missing_mp3", True), ("mp3_file_missing", True), ("mp3_without_transcript", True), ("youtube_link", True), ("wordpress_link", True),
    ("no_external_source", True), ("missing_duration", True), ("suspicious_duration", True), ("missing_title", True), ("missing_preacher", True),
    ("missing_bible_reference", True), ("missing_series", True), ("short_transcript", True), ("invalid_link", True), ("unreachable_link", True),
    ("silver_missing_gold", False), ("orphan_media", False), ("orphan_transcripts", False), ("possible_duplicates", False), ("missing_sundays", False),
    ("justified_missing_sundays", False), ("failed_pipeline_runs_7d", False), ("stale_pipeline", False),
]
ISSUE = ("metric_key", "entity_id", "preaching_date", "title", "preacher_name", "source_system", "detail", "link")
LINKS = ("youtube_link", "wordpress_link", "download_link", "image_link")


@dataclass(frozen=True)
class Limits:
    min_minutes: float = 10
    max_minutes: float = 150
    min_words: int = 100
    grace_days: int = 2
    checked_domains: tuple[str, ...] = ("youtube.com", "youtu.be")


KEY = "canonical_sermon_id"
#: Rows of all tables that a task aggregates, about.
TASK_ROWS = 250_000


def talk_states(gold: DataFrame, sources: DataFrame, media: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    """One row for each talk that any table knows: its gold row, what the others have of it, and whether they do.

    The tables are laid one under the other, tagged, and meet in one aggregate,
    so each is exchanged once and what exists is read from the row. Words are
    counted before, so texts do not travel. Audio files are joined to the narrow
    media rows by path, so talks are exchanged by key only; a task aggregates
    about :data:`TASK_ROWS` of the rows, however many there are.
    """
    parts = sum(df.count() for df in (gold, sources, media, texts)) // TASK_ROWS
    parts = parts and max(parts, gold.sparkSession.sparkContext.defaultParallelism)
    dealt = lambda df, key: df.repartition(parts, key) if parts else df
    sized = dealt(files.select("path", "length"), "path").groupBy("path").agg(F.max("length").alias("length"))
    media = dealt(media.withColumnRenamed("local_path", "path"), "path").join(sized, "path", "left")
    served = F.struct(*[c for c in gold.columns if c != KEY])
    shapes = {
        "g": served,
        "m": F.struct(F.struct("source_system", "source_item_id").alias("rank"), text("title").alias("title"), text("preacher_name").alias("preacher_name")),
        "a": F.struct("asset_type", "path", F.col("duration_seconds").cast("double").alias("seconds"), "length"),
        "t": F.struct(F.struct("created_at", "transcript_version").alias("rank"), word_count("transcript_text").alias("words")),
    }
    tagged, kinds = [], {}
    for tag, df in (("g", gold), ("m", sources), ("a", media), ("t", texts)):
        own = df.where(~is_blank(KEY)).select(F.col(KEY).cast("string").alias(KEY), shapes[tag].alias(tag))
        kinds[tag] = own.schema[tag].dataType
        tagged.append((tag, own))
    rows = None
    for tag, own in tagged:
        full = own.select(KEY, *[F.col(tag) if tag == other else F.lit(None).cast(kind).alias(other) for other, kind in kinds.items()])
        rows = full if rows is None else rows.unionByName(full)
    audio = F.when(F.col("a.asset_type") == "audio", F.struct("a.path", "a.seconds", "a.length"))
    states = dealt(rows, KEY).groupBy(KEY).agg(
        F.first("g", ignorenulls=True).alias("g"),
        F.count_if(F.col("g").isNotNull()).alias("n_gold"),
        F.array_join(F.array_sort(F.collect_set(F.nullif("m.rank.source_system", F.lit("")))), ", ").alias("sources"),
        F.min_by(F.when(F.col("m").isNotNull(), F.struct("m.title", "m.preacher_name")), "m.rank").alias("m"),
        F.count_if(F.col("m").isNotNull()).alias("n_meta"),
        F.max(audio).alias("audio"),
        F.collect_list("a.path").alias("paths"),  # a talk has one asset of a kind
        F.count_if(F.col("a").isNotNull()).alias("n_media"),
        F.max_by("t.words", "t.rank").alias("words"),
        F.count_if(F.col("t").isNotNull()).alias("n_texts"),
    )
    return states.withColumns({"path": F.col("audio.path"), "audio_seconds": F.col("audio.seconds"), "length": F.col("audio.length")}).drop("audio")


def wide_rows(states: DataFrame) -> DataFrame:
    """The catalogue with its sources, audio file and count of words, from :func:`talk_states`."""
    out = states.where("n_gold > 0").select(KEY, "g.*", F.nullif("sources", F.lit("")).alias("source_system"), "path", "audio_seconds", "length", "words")
    have = [c for c in LINKS if c not in out.columns]
    return out.withColumns({c: F.lit(None).cast("string") for c in have}) if have else out


def wide_catalog(gold: DataFrame, sources: DataFrame, media: DataFrame, files: DataFrame, texts: DataFrame) -> DataFrame:
    return wide_rows(talk_states(gold, sources, media, files, texts))


def _issue(metric: str | Column, detail: Column | None = None, link: Column | None = None) -> Column:
    plain = lambda c: c if c is not None else F.lit("")
    return F.struct(F.lit(metric).alias("metric_key") if isinstance(metric, str) else metric.alias("metric_key"), plain(detail).alias("detail"), plain(link).alias("link"))


def row_rules(limits: Limits) -> list[tuple[str, Column, Column]]:
    """``(rule, condition, detail)`` over the wide catalogue."""
    there, minutes = F.col("length").isNotNull(), F.col("audio_seconds") / 60
    blank = F.lit("")
    return [
        ("total_sermons", F.lit(True), blank),
        ("missing_mp3", is_blank("path"), blank),
        ("mp3_file_missing", ~is_blank("path") & ~there, text("path")),
        ("mp3_without_transcript", there & F.col("words").isNull(), blank),
        ("youtube_link", ~is_blank("youtube_link"), blank),
        ("wordpress_link", ~is_blank("wordpress_link"), blank),
        ("no_external_source", is_blank("youtube_link") & is_blank("wordpress_link"), blank),
        ("missing_duration", there & F.col("audio_seconds").isNull(), blank),
        ("suspicious_duration", F.coalesce(~minutes.between(limits.min_minutes, limits.max_minutes), F.lit(False)), F.format_string("%.1f", minutes)),
        ("missing_title", is_blank("title"), blank),
        ("missing_preacher", is_blank("preacher_name"), blank),
        ("missing_bible_reference", is_blank("text_reference"), blank),
        ("missing_series", is_blank("serie"), blank),
        ("short_transcript", F.coalesce(F.col("words") < limits.min_words, F.lit(False)), F.col("words").cast("string")),
    ]


def row_issues(wide: DataFrame, limits: Limits) -> DataFrame:
    """All row rules in one scan: an array of issues per talk, exploded."""
    made = []
    for rule, condition, detail in row_rules(limits):
        link = F.when(is_valid_link(rule), text(rule)).otherwise("") if rule in LINKS else None
        made.append(F.when(condition, _issue(rule, detail, link)))
    for c in LINKS:
        made.append(F.when(~is_valid_link(c), _issue("invalid_link", F.lit(c), text(c))))
    rows = wide.select("canonical_sermon_id", "preaching_date", "title", "preacher_name", "source_system", F.inline(F.array_compact(F.array(*made))))
    return rows.withColumnRenamed("canonical_sermon_id", "entity_id").select(*ISSUE)


def unreachable(wide: DataFrame, status: DataFrame, limits: Limits) -> DataFrame:
    """Checkable links whose probe failed, from ``status(url, code, error)``; 401, 403 and 429 are no failures.

    Many talks may have one address, so links stream past the failed ones and are not sorted by it.
    """
    links = wide.select("canonical_sermon_id", "preaching_date", "title", "preacher_name", "source_system", F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("url")) for c in LINKS])))
    links = links.where(is_checkable("url", limits.checked_domains) & F.lower("url").rlike("^https?://"))
    bad = status.where(~is_blank("error") | ((F.col("code") >= 400) & ~F.col("code").isin(401, 403, 429)))
    rows = links.join(bad.hint("shuffle_hash"), "url").select(F.lit("unreachable_link").alias("metric_key"), F.col("canonical_sermon_id").alias("entity_id"), "preaching_date", "title", "preacher_name", "source_system", F.coalesce(F.nullif("error", F.lit("")), F.concat(F.lit("HTTP "), F.col("code").cast("string"))).alias("detail"), F.col("url").alias("link"))
    return rows.select(*ISSUE)


def _shaped(df: DataFrame, metric: str | Column, entity: Column, **given: Column) -> DataFrame:
    columns = {"metric_key": F.lit(metric) if isinstance(metric, str) else metric, "entity_id": entity} | given
    return df.select(*[columns.get(c, F.lit("")).cast("string").alias(c) for c in ISSUE])


def set_issues(states: DataFrame) -> DataFrame:
    """What one table has of a talk and another lacks, read from :func:`talk_states`; dates with several talks."""
    served = states.where("n_gold > 0").select(KEY, "g.preaching_date")
    lost = states.where("n_meta > 0 AND n_gold = 0")
    media = states.where("n_meta = 0 AND n_media > 0").select(KEY, F.explode_outer("paths").alias("path"))
    parts = [
        _shaped(lost, "silver_missing_gold", F.col(KEY), title=F.col("m.title"), preacher_name=F.col("m.preacher_name"), source_system=F.col("sources")),
        _shaped(media, "orphan_media", F.col(KEY), detail=text("path")),
        _shaped(states.where("n_meta = 0 AND n_texts > 0"), "orphan_transcripts", F.col(KEY)),
        _shaped(aggs.duplicate_keys(served, "preaching_date", KEY, unique=True), "possible_duplicates", F.col("preaching_date"), preaching_date=F.col("preaching_date"), detail=F.col("ids")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def calendar_issues(gold: DataFrame, exceptions: DataFrame, start: dt.date, today: dt.date, limits: Limits) -> DataFrame:
    gaps = missing_weekdays(gold, exceptions, start, today, limits.grace_days)
    day = F.col("day").cast("string")
    return _shaped(gaps, F.when(F.col("justified"), "justified_missing_sundays").otherwise("missing_sundays"), day, preaching_date=day, detail=text("reason"))


def run_issues(runs: DataFrame, now: dt.datetime) -> DataFrame:
    failed = runs.where((F.col("status") == "failed") & (F.col("calculated_at") >= F.lit(now - dt.timedelta(days=7))) & (F.col("calculated_at") <= F.lit(now)))
    stale = aggs.freshness(runs, now).where("stale")
    return _shaped(failed, "failed_pipeline_runs_7d", F.col("run_id")).unionByName(_shaped(stale, "stale_pipeline", F.lit("pipeline")))


def quality_snapshot(tables: dict[str, DataFrame], start: dt.date, now: dt.datetime, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(issues, metrics) of a catalogue.

    ``tables``: gold, metadata, media, files, texts, exceptions, runs, link_status.
    Issue ids are hashes of rule, entity and detail, so a repeated run gives the same.
    """
    states = stored(talk_states(tables["gold"], tables["metadata"], tables["media"], tables["files"], tables["texts"]), "talks")  # all rules read it
    wide = wide_rows(states)
    issues = (
        row_issues(wide, limits)
        .unionByName(unreachable(wide, tables["link_status"], limits))
        .unionByName(set_issues(states))
        .unionByName(calendar_issues(wide, tables["exceptions"], start, now.date(), limits))
        .unionByName(run_issues(tables["runs"], now))
    )
    issues = issues.withColumn("issue_id", F.sha2(F.concat_ws("\x1f", *[text(c) for c in ("metric_key", "entity_id", "detail", "link")]), 256))
    return issues, aggs.metric_rows(issues, RULES, wide)

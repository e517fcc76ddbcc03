"""What the archive's pages ask: dashboards, catalogue, details and texts, as DataFrames."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions import text as x
from medialake.functions import times as t
from medialake.operators import aggs, filters, grams, joins, pick


def analytics_dashboard(events: DataFrame, visitors: DataFrame, talks: DataFrame, studies: DataFrame, period: t.Period, tz: str = t.ZONE, content_type: str = "") -> dict[str, DataFrame]:
    """Key figures, series and rankings of a period.

    The period's events are read by about ten aggregates; the caller may persist
    ``events`` narrowed to the period, each answer is one small frame.
    """
    own = filters.time_range(events, "occurred_at", period.start_utc, period.end_utc)
    scoped = own.where(filters.content_scope(content_type))
    stats = joins.enrich_content(aggs.content_stats(scoped), talks, studies)
    daily = t.daily_series(events, period.start, period.end, tz, content_type)
    by = [F.asc("content_type"), F.asc("content_id")]
    views = own.where("event_type = 'page_view'").groupBy("page_path").agg(F.count("*").alias("views"))
    dims = aggs.plays_by_dims(scoped, talks)
    return {
        "kpis": aggs.kpis(own, visitors, period.start, tz, content_type),
        "daily": daily,
        "weekly": t.rollup_series(daily, "week"),
        "monthly": t.rollup_series(daily, "month"),
        "content": aggs.top_k(stats, [F.desc("plays"), F.desc("downloads"), F.desc("completions"), *by], 25),
        "downloads": aggs.top_k(stats.where("downloads > 0"), [F.desc("downloads"), F.desc("plays"), *by], 15),
        "pages": aggs.top_k(views, [F.desc("views"), F.asc("page_path")], 15),
        **{d: aggs.top_k(dims.where(F.col("dimension") == d), [F.desc("plays"), F.asc("name")], 10) for d in ("speaker", "serie", "book")},
        "rates": aggs.seconds_by_rate(scoped),
        "clicks": aggs.clicks_by_type(own),
    }


def quality_dashboard(runs: DataFrame, metrics: DataFrame, issues: DataFrame, run_id: str | None = None, metric: str | None = None, **filters_: str) -> dict[str, DataFrame]:
    """The chosen run, its metrics with change and share, the history, facets and the issues asked for."""
    run = pick.pick_run(runs, run_id)
    own = issues.join(run.select("run_id"), "run_id", "left_semi")
    if metric:
        own = own.where(F.col("metric_key") == metric)
    shown = aggs.order_issues(filters.filter_issues(own, **filters_))
    return {"run": run, "metrics": pick.metric_delta(metrics, runs).join(run.select("run_id"), "run_id", "left_semi"), "history": t.metric_history(runs, metrics), "facets": aggs.facets(own), "issues": shown}


def present(df: DataFrame) -> DataFrame:
    """Catalogue rows with what a page shows: book, date and minutes."""
    return df.withColumns({"book": x.book_name("text_reference"), "shown_date": x.fmt_date("preaching_date"), "shown_duration": x.fmt_minutes("duration_seconds")})


def catalog(gold: DataFrame) -> dict[str, DataFrame]:
    """The catalogue's overview pages."""
    return {
        "recent": present(aggs.newest(gold, 20)),
        "books": aggs.count_books(gold),
        "series": aggs.count_by(gold, "serie"),
        "series_by_speaker": aggs.count_by(gold, "serie", "preacher_name"),
        "speakers": aggs.count_by(gold, "preacher_name"),
        "years": aggs.count_years(gold),
        "stats": aggs.catalog_stats(gold),
        "composition": aggs.two_class_share(gold),
        "updated": aggs.last_update(gold, "last_aggregated_at") if "last_aggregated_at" in gold.columns else aggs.last_update(gold, "preaching_date"),
    }


#: Columns that a search looks into.
SEARCHED = ["title", "preacher_name", "serie", "text_reference"]


def search_talks(gold: DataFrame, query: str, n: int = 20, postings: DataFrame | None = None) -> DataFrame:
    """The newest talks with the query in a searched column; ``postings`` of these columns spare the scan."""
    found = filters.search(gold, SEARCHED, query) if postings is None else grams.search_postings(gold, "canonical_sermon_id", SEARCHED, query, postings)
    return present(aggs.newest(found, n))


def _study_rows(studies: DataFrame) -> DataFrame:
    """Studies with the year they are shown under, ``back`` to order the years by, and what orders the studies of a year."""
    year = F.substring(x.text("study_date"), 1, 4)
    place = x.study_place("study_type", "title", "study_date")
    item = F.struct(place.alias("ord"), x.text("title").alias("title"), "study_id", "study_date", F.col("resource_count").alias("resources"))
    return studies.select("study_type", x.first_filled(year, F.lit("Sem data")).alias("year"), (-F.coalesce(year.try_cast("int"), F.lit(0))).alias("back"), item.alias("item"))


def study_listing(studies: DataFrame) -> DataFrame:
    """The catalogue as a row a study, for any number of studies: its type with name and count, its year and study with their places from 0.

    Studies are sorted in ranges and numbered through; what the groups before
    hold, a row each, turns that into places within a year. No group is gathered.
    """
    group = ["study_type", "back", "year"]
    rows = _study_rows(studies).where(F.col("study_type").isin(*x.STUDY_TYPES))
    ordered = aggs.placed(rows.orderBy(*group, "item"))
    of_type = Window.partitionBy("study_type")
    starts = ordered.groupBy(*group).agg(F.min("place").alias("__start"), F.count("*").alias("__n"))
    starts = starts.withColumns({"count": F.sum("__n").over(of_type), "year_place": F.row_number().over(of_type.orderBy("back", "year")) - 1}).drop("__n")
    types = studies.sparkSession.createDataFrame(list(x.STUDY_TYPES.items()), "study_type string, label string")
    shown = ordered.join(starts, group).join(types, "study_type")
    return shown.select("study_type", "label", "count", "year_place", "year", (F.col("place") - F.col("__start")).cast("int").alias("place"), "item.title", "item.study_id", "item.study_date", "item.resources")


def study_catalog(studies: DataFrame) -> DataFrame:
    """The four types in their order, also those without studies, with name, count, and years from the newest on with their studies.

    A type is one row with all its studies, as a page shows them; :func:`study_listing` has no such row.
    """
    groups = _study_rows(studies).groupBy("study_type", "back", "year").agg(F.array_sort(F.collect_list("item")).alias("studies"))
    nested = groups.groupBy("study_type").agg(F.sum(F.size("studies")).alias("__n"), F.array_sort(F.collect_list(F.struct("back", "year", "studies"))).alias("years"))
    types = studies.sparkSession.createDataFrame(list(x.STUDY_TYPES.items()), "study_type string, label string")
    shown = types.join(nested, "study_type", "left").select("study_type", "label", F.coalesce("__n", F.lit(0)).alias("count"), "years")
    return shown.orderBy(x.place_of("study_type", x.STUDY_TYPES))


def study_detail(studies: DataFrame, resources: DataFrame, study_id: str) -> DataFrame:
    """One study with its resources by group, in the order of the groups."""
    group = filters.resource_group("resource_type", "mime_type", "download_link")
    own = resources.where(F.col("study_id") == study_id).withColumn("grp", group).withColumns({"ord": x.place_of("grp", x.RESOURCE_GROUPS), "label": F.regexp_replace(x.text("label"), r" \[[0-9a-f]{12}\]", "")})
    groups = own.groupBy("study_id", "ord", "grp").agg(F.array_sort(F.collect_list(F.struct("position", "label", "canonical_url", x.fmt_duration("duration_seconds").alias("duration")))).alias("items"))
    nested = groups.groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct("ord", "grp", "items"))).alias("groups"))
    return studies.where(F.col("study_id") == study_id).join(nested, "study_id", "left")


def latest_text(gold: DataFrame, texts: DataFrame, ident: str) -> DataFrame:
    """The newest text of a talk with the talk's record; no row where there is none."""
    key = "canonical_sermon_id"
    newest = pick.latest(texts.where(F.col(key) == ident), [key], ["created_at", "transcript_version"])
    return joins.with_parent(newest, gold.where(F.col(key) == ident), key)


def day_cut_report(videos: DataFrame, date: str, tz: str = t.ZONE) -> DataFrame:
    """How a day's cut went: number of videos, latest upload, longest talk, and whether each was found."""
    out = pick.day_report(videos, date, tz)
    return out.withColumns({"latest_found": F.col("latest_id").isNotNull(), "talk_found": F.col("talk_id").isNotNull(), "date": F.lit(dt.date.fromisoformat(date).isoformat())})

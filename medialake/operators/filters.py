"""Filters: scopes, searches, admission and validation of events."""

from __future__ import annotations

import datetime as dt
import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialake.functions.text import book_name, is_blank, is_placeholder_content, text
from medialake.functions.times import clamp, local_date, to_instant
from medialake.functions.urls import ref_host


def date_scope(df: DataFrame, column: str, loopback_days: int | None = None, exact: str | None = None, today: dt.date | None = None, strict: bool = False) -> DataFrame:
    """Rows of an exact date, else of the last days, else all. ISO text is compared as text, so partial dates stay strings."""
    if exact:
        return df.where(F.col(column) == dt.date.fromisoformat(exact).isoformat())
    if loopback_days is None or loopback_days <= 0:
        if strict and loopback_days is not None:
            raise ValueError("look-back days must be positive")
        return df
    cutoff = (today or dt.date.today()) - dt.timedelta(days=loopback_days)
    return df.where(F.col(column) >= cutoff.isoformat())


def recent(df: DataFrame, column: str, days: int, now: dt.datetime) -> DataFrame:
    return df.where(to_instant(column) >= F.lit(now - dt.timedelta(days=days)))


def date_window(df: DataFrame, columns: list[str], date: str, margin: int, tz: str, key: str) -> DataFrame:
    """Rows any of whose instants falls within ``margin`` local days of a date, one per key."""
    day = dt.date.fromisoformat(date)
    a, b = F.lit(day - dt.timedelta(days=margin)), F.lit(day + dt.timedelta(days=margin))
    near = functools.reduce(operator.or_, [F.coalesce(local_date(to_instant(c), tz).between(a, b), F.lit(False)) for c in columns])
    return df.where(near).dropDuplicates([key])


def published(df: DataFrame, max_date: str, category: str, content: str = "content", status: str = "status", date: str = "post_date", categories: str = "categories") -> DataFrame:
    """Items out by a date, published or without status, in a category, with real content."""
    return df.where((text(date) <= max_date) & text(status).isin("publish", "") & F.array_contains(categories, category) & ~is_placeholder_content(content))


def search(df: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows with the query in any column, whatever its case; ``%`` and ``_`` are wildcards."""
    pattern = f"%{query.lower()}%"
    return df.where(functools.reduce(operator.or_, [F.lower(text(c)).like(pattern) for c in columns]))


def lookup(df: DataFrame, column: str, value: str, mode: str = "equal") -> DataFrame:
    """Rows by equality or prefix of a column, or by the book of a reference."""
    c = text(column)
    match = {"equal": c == value, "prefix": c.startswith(value), "book": book_name(column) == value}[mode]
    return df.where(match)


def filter_issues(df: DataFrame, year: str | None = None, source: str | None = None, speaker: str | None = None) -> DataFrame:
    rules = [(year, lambda v: text("preaching_date").startswith(v)), (source, lambda v: F.lower(text("source_system")).contains(v.lower())), (speaker, lambda v: F.col("preacher_name") == v)]
    return functools.reduce(lambda d, r: d.where(r[1](r[0])) if r[0] else d, rules, df)


def time_range(df: DataFrame, column: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Half-open range of instants, pushed down to the scan."""
    return df.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end)))


def content_scope(content_type: str) -> Column:
    return F.lit(True) if not content_type else F.col("content_type") == content_type


#: Event and content types that are taken (fixed values).
EVENT_TYPES = ("page_view", "youtube_click", "site_click", "transcript_click", "download", "audio_play", "audio_progress", "audio_complete", "audio_speed")
FREE_TYPES = ("page_view", "youtube_click", "site_click", "transcript_click")
CONTENT_TYPES = ("", "sermon", "study")
MAX_BODY = 65_536
_ID = r"^[A-Za-z0-9_.:-]{1,200}$"


def admit(df: DataFrame, length: str = "content_length", agent: str = "user_agent", origin: str = "origin", host: str = "host") -> DataFrame:
    """Requests of a sound size, not from robots, from the same site where an origin is given."""
    same = (text(origin) == "") | (F.lower(F.regexp_extract(text(origin), "^[a-z]+://([^/]+)", 1)) == F.lower(text(host)))
    return df.where((F.coalesce(F.col(length), F.lit(0)) <= MAX_BODY) & ~F.lower(text(agent)).rlike("bot|crawler|spider|slurp") & same)


def identifier(c: Column | str) -> Column:
    v = F.trim(text(c))
    return F.when(v.rlike(_ID), v).otherwise("")


def site_path(c: Column | str) -> Column:
    v = F.substring(F.trim(text(c)), 1, 500)
    return F.when(v.rlike("^/(?!/)"), v).otherwise("")


def validate_events(df: DataFrame) -> DataFrame:
    """Raw events cleaned: unknown types dropped, ids and paths checked, numbers clamped.

    Expects the raw columns of an event; other columns are kept.
    """
    ok = text("event_type").isin(*EVENT_TYPES) & text("content_type").isin(*CONTENT_TYPES)
    named = text("event_type").isin(*FREE_TYPES) | ((text("content_type") != "") & (identifier("content_id") != ""))
    return df.where(ok & named).withColumns(
        {
            "event_id": identifier("event_id"),
            "event_type": text("event_type"),
            "content_type": text("content_type"),
            "content_id": identifier("content_id"),
            "resource_id": identifier("resource_id"),
            "page_path": site_path("page_path"),
            "position_seconds": clamp("position_seconds"),
            "duration_seconds": clamp("duration_seconds"),
            "listened_seconds": clamp("listened_seconds", 0.0, 60.0),
            "playback_rate": clamp("playback_rate", 0.25, 4.0),
            "referrer_domain": ref_host("referrer"),
        }
    )


def is_mp3(mime: Column | str, path: Column | str) -> Column:
    return (F.lower(text(mime)) == "audio/mpeg") | F.lower(text(path)).endswith(".mp3")


def resource_group(kind: Column | str, mime: Column | str, link: Column | str) -> Column:
    """Where a resource is shown: audio (also anything fetched as MP3), documents, else its own kind; without one, as a link."""
    kind = F.coalesce(F.nullif(F.col(kind) if isinstance(kind, str) else kind, F.lit("")), F.lit("external_link"))
    fetched = is_mp3(mime, text(link)) & ~is_blank(link)
    return F.when((kind == "audio") | fetched, "audio").when(kind.isin("pdf", "word", "document", "presentation", "spreadsheet", "archive"), "documents").otherwise(kind)


def target(df: DataFrame, date: str | None = None, column: str = "preaching_date") -> DataFrame:
    """The talk of a date, or the newest; raises where there is none."""
    out = df.where(F.col(column) == date) if date else df.orderBy(F.desc_nulls_last(column)).limit(1)
    if out.isEmpty():
        raise LookupError(f"no talk for {date or 'any date'}")
    return out



"""Dates, durations, ratios and calendar series."""

from __future__ import annotations

import datetime as dt
import uuid
import zoneinfo
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import col, first_filled, text

ZONE = "America/Sao_Paulo"


def local_date(ts: Column | str, tz: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(col(ts), tz))


def fixed_offset_date(ts: Column | str, hours: int = 3) -> Column:
    """Date under a fixed offset behind UTC, without daylight saving."""
    return F.to_date(col(ts) - F.expr(f"INTERVAL {hours} HOURS"))


def iso_duration_seconds(c: Column | str) -> Column:
    """Seconds of ``PnDTnHnMnS``; null where the text is no such duration."""
    v = F.upper(F.trim(text(c)))
    fits = v.rlike(r"^P(?=\d|T\d)(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+(\.\d+)?S)?)?$")
    piece = lambda unit: F.coalesce(F.regexp_extract(v, rf"(\d+(?:\.\d+)?){unit}", 1).try_cast("double"), F.lit(0.0))
    return F.when(fits, piece("D") * 86400 + piece("H") * 3600 + piece("M") * 60 + piece("S"))


def has_positive_duration(seconds: Column, iso: Column | str) -> Column:
    """Numeric seconds above 0; without a number, an ISO text other than the zero one."""
    number = seconds.try_cast("double")
    return F.when(number.isNotNull(), number > 0).otherwise(~F.upper(F.trim(text(iso))).isin("", "P0D"))


@dataclass(frozen=True)
class Period:
    start: dt.date
    end: dt.date
    start_utc: dt.datetime
    end_utc: dt.datetime


def resolve_period(start: str | None, end: str | None, days: int, today: dt.date, retention: int, tz: str = ZONE) -> Period:
    """Reporting days and their half-open UTC bounds; bad input falls back, all is held to today and the retention."""

    def parse(v: str | None) -> dt.date | None:
        try:
            return dt.date.fromisoformat(v or "")
        except ValueError:
            return None

    last = min(parse(end) or today, today)
    first = parse(start) or last - dt.timedelta(days=max(1, days) - 1)
    first = min(max(first, today - dt.timedelta(days=retention - 1)), last)
    zone, utc = zoneinfo.ZoneInfo(tz), dt.UTC
    bound = lambda d: dt.datetime.combine(d, dt.time(), zone).astimezone(utc).replace(tzinfo=None)
    return Period(first, last, bound(first), bound(last + dt.timedelta(days=1)))


def week_start(d: Column | str) -> Column:
    return F.to_date(F.date_trunc("week", col(d)))


def month_key(d: Column | str) -> Column:
    return F.date_format(col(d), "yyyy-MM")


def clamp(c: Column | str, low: float = 0.0, high: float = 86400.0) -> Column:
    """A number within bounds; null where the value is none."""
    v = col(c).try_cast("double")
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def pct(num: Column, den: Column, places: int = 1) -> Column:
    """Percentage rounded half to even; 0 for an empty denominator."""
    return F.coalesce(F.bround(num * 100.0 / F.nullif(den, F.lit(0)), places), F.lit(0.0))


def bytes_estimate(kind: Column | str, size: Column, listened: Column, rate: Column, duration: Column) -> Column:
    """Transfer of an event: the file for a download, its heard share for progress, else nothing."""
    share = F.least(F.lit(1.0), F.coalesce(listened, F.lit(0.0)) * F.coalesce(F.nullif(rate, F.lit(0.0)), F.lit(1.0)) / F.nullif(duration, F.lit(0.0)))
    return F.coalesce(F.when(col(kind) == "download", size).when(col(kind) == "audio_progress", F.bround(size * share, 0)), F.lit(0)).cast("long")


def oldest_date(given: Column, video_dates: Column, published: Column) -> Column:
    """A playlist's date: its own, else its oldest video's, else its publication's."""
    return first_filled(given, F.array_min(F.filter(video_dates, lambda x: F.trim(text(x)) != "")), published)


def to_instant(c: Column | str) -> Column:
    return col(c).try_cast("timestamp")


def run_context(now: dt.datetime | None = None, run_id: str | None = None) -> tuple[dt.datetime, str]:
    return now or dt.datetime.now(dt.UTC).replace(tzinfo=None), run_id or uuid.uuid4().hex


def days_between(spark: SparkSession, start: dt.date | str, end: dt.date | str, step: int = 1) -> DataFrame:
    """Days from ``start`` to ``end``, both included, as column ``day``."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(DATE'{start}', DATE'{end}', INTERVAL {step} DAYS)")).alias("day"))


def daily_series(events: DataFrame, start: dt.date, end: dt.date, tz: str = ZONE, content_type: str = "") -> DataFrame:
    """Page views, plays and downloads for every local day, zero where nothing happened.

    The content type narrows plays and downloads only. Counting is done before
    the days are filled in, so one row a day meets the calendar.
    """
    own = F.lit(True) if not content_type else F.col("content_type") == content_type
    lo, hi = (dt.datetime.combine(d, dt.time()) for d in (start - dt.timedelta(days=1), end + dt.timedelta(days=2)))
    counted = (
        events.where((F.col("occurred_at") >= F.lit(lo)) & (F.col("occurred_at") < F.lit(hi)))
        .groupBy(local_date("occurred_at", tz).alias("day"))
        .agg(
            F.count_if(F.col("event_type") == "page_view").alias("views"),
            F.count_if((F.col("event_type") == "audio_play") & own).alias("plays"),
            F.count_if((F.col("event_type") == "download") & own).alias("downloads"),
        )
    )
    zero = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("views", "plays", "downloads")}
    return days_between(events.sparkSession, start, end).join(counted, "day", "left").select("day", *zero.values())


def rollup_series(daily: DataFrame, grain: str) -> DataFrame:
    """A daily series summed to weeks (from Monday) or months."""
    key = {"week": week_start("day").cast("string"), "month": month_key("day")}[grain]
    return daily.groupBy(key.alias("bucket")).agg(*[F.sum(c).alias(c) for c in ("views", "plays", "downloads")])


def weekday_bounds(start: dt.date, today: dt.date, grace: int, floor: dt.date = dt.date(2009, 1, 1)) -> tuple[dt.date, dt.date]:
    """First Sunday from ``start`` (or ``floor``) on, last Sunday ``grace`` days before today."""
    first = max(start, floor)
    first += dt.timedelta(days=(6 - first.weekday()) % 7)
    last = today - dt.timedelta(days=grace)
    return first, last - dt.timedelta(days=(last.weekday() + 1) % 7)


def missing_weekdays(dates: DataFrame, exceptions: DataFrame, start: dt.date, today: dt.date, grace: int = 2) -> DataFrame:
    """Sundays without a date in ``dates``: ``day, justified, reason``."""
    first, last = weekday_bounds(start, today, grace)
    spine = days_between(dates.sparkSession, first, max(first, last), 7).where(F.col("day") <= F.lit(last))
    gaps = spine.join(dates.select(F.col("preaching_date").cast("date").alias("day")).distinct(), "day", "left_anti")
    why = exceptions.select(F.col("preaching_date").cast("date").alias("day"), "reason")
    return gaps.join(why, "day", "left").select("day", F.col("reason").isNotNull().alias("justified"), "reason")


def metric_history(runs: DataFrame, metrics: DataFrame, n: int = 1300) -> DataFrame:
    """The last ``n`` metric rows of successful runs with their share, oldest first."""
    rows = metrics.join(runs.where("status = 'success'").select("run_id", "calculated_at"), "run_id")
    last = rows.orderBy(F.desc("calculated_at"), "metric_key").limit(n)
    return last.select("run_id", "calculated_at", "metric_key", "value", "denominator", pct(F.col("value"), F.col("denominator")).alias("percent")).orderBy("calculated_at", "metric_key")

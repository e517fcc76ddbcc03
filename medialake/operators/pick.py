"""Choosing one row, or one value per column, out of many: no sort where an aggregate will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medialake.functions.text import is_blank, is_placeholder
from medialake.functions.times import has_positive_duration, iso_duration_seconds, local_date


def rows_by(df: DataFrame, keys: list[str], order: list[Column], largest: bool = True) -> DataFrame:
    """The row of each key with the largest (or smallest) ``order``, by one aggregate that combines map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = (F.max_by if largest else F.min_by)(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*").select(*df.columns)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest version per key."""
    return rows_by(df, keys, [F.col(c) for c in order])


def best_candidate(df: DataFrame, date: str = "preaching_date") -> DataFrame:
    """Per date the candidate that has a duration, then the latest, then one with playlists, then the largest id."""
    return rows_by(df, [date], [has_positive_duration(F.lit(None), F.col("duration")), F.col("published_at"), F.col("has_playlists"), F.col("video_id")])


def fill_from_group(df: DataFrame, key: str, columns: list[str], winner: Column, arrival: str) -> DataFrame:
    """Per key, each column's first filled value: the winner's, else that of the others in order of arrival."""
    order = F.struct(~winner, F.col(arrival))
    return df.groupBy(key).agg(*[F.min_by(F.when(~is_blank(c), F.col(c)), F.when(~is_blank(c), order)).alias(c) for c in columns])


def metric_delta(metrics: DataFrame, runs: DataFrame) -> DataFrame:
    """Each metric of a successful run beside that of the successful run before."""
    good = runs.where("status = 'success'").select("run_id", "calculated_at")
    before = good.withColumn("previous", F.lag("run_id").over(Window.orderBy("calculated_at", "run_id")))  # one row a run
    rows = metrics.join(before, "run_id")
    old = metrics.select(F.col("run_id").alias("previous"), "metric_key", F.col("value").alias("previous_value"))
    joined = rows.join(old, ["previous", "metric_key"], "left")
    return joined.select("run_id", "metric_key", "value", "previous_value", (F.col("value") - F.col("previous_value")).alias("delta"), F.bround(F.col("value") * 100.0 / F.nullif(F.col("denominator"), F.lit(0)), 1).alias("percent"))


def quality_score(*columns: str) -> Column:
    """One for every filled field, minus ten for a placeholder."""
    score = F.lit(0)
    for c in columns:
        filled = F.coalesce(F.col(c), F.lit("")) != ""
        score = score + F.when(filled & is_placeholder(c), -10).when(filled, 1).otherwise(0)
    return score


def survivorship(df: DataFrame, key: str, columns: list[str], order: list[Column]) -> DataFrame:
    """One row per key; every column holds its first real value in the given order.

    Blank and placeholder values never win over real ones. One aggregate with
    filtered ``min_by``; nothing is sorted and partial results combine map-side.
    """
    rank = F.struct(*order)
    valid = lambda c: ~is_blank(c) & ~is_placeholder(c)
    return df.groupBy(key).agg(*[F.min_by(F.when(valid(c), F.col(c)), F.when(valid(c), rank)).alias(c) for c in columns])


def preferred(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    return rows_by(df, [key], order, largest=False)


def dedupe_merge_sources(df: DataFrame, keys: list[str], order: list[Column], source: str = "source_system", separator: str = ", ") -> DataFrame:
    """The first row per key, with the sources of all its duplicates."""
    rest = [c for c in df.columns if c not in (*keys, source)]
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__row"), F.array_join(F.array_sort(F.collect_set(source)), separator).alias("sources"))
    return out.select(*keys, "__row.*", "sources")


def dedupe_links(df: DataFrame, keys: list[str], is_raw: str = "is_raw", position: str = "position") -> DataFrame:
    """Per key the last link from a tag; a link from plain text, the first, only where no tag has it."""
    order = [F.col(is_raw), F.when(F.col(is_raw), F.col(position)).otherwise(-F.col(position))]
    return rows_by(df, keys, order, largest=False)


def first_by(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows_by(df, [key], [F.col(c) for c in order], largest=False)


def explode_dedupe(df: DataFrame, array: str, ident: str) -> DataFrame:
    """Items of an array with their 1-based place; an id that comes again is left out."""
    keep = [c for c in df.columns if c != array]
    items = df.select(*keep, F.posexplode(array).alias("__pos", "__item")).select(*keep, (F.col("__pos") + 1).alias("position"), "__item.*")
    return rows_by(items.where(~is_blank(ident)), [*keep, ident], [F.col("position")], largest=False)


def day_report(videos: DataFrame, date: str, tz: str = "America/Sao_Paulo") -> DataFrame:
    """For one local day: how many videos, the latest upload, and the longest talk."""
    own = videos.where(local_date("published_at", tz) == F.lit(date).cast("date"))
    seconds = F.coalesce(iso_duration_seconds("duration"), F.lit(0.0))
    return own.agg(
        F.count("*").alias("n_videos"),
        F.max_by("video_id", F.struct("published_at", "video_id")).alias("latest_id"),
        F.max_by("video_id", F.when(F.col("is_talk"), F.struct(seconds, F.col("published_at"), F.col("video_id")))).alias("talk_id"),
        F.coalesce(F.max(F.when(F.col("is_talk"), seconds)), F.lit(0.0)).alias("talk_seconds"),
    )


def label_with_year(df: DataFrame, identity: str = "identity", source: str = "source_system", url: str = "url", date: str = "study_date") -> DataFrame:
    """Origin labels; a source with several linked rows in a group gets the year behind its name."""
    linked = df.where(~is_blank(url)).groupBy(identity, source).agg(F.count("*").alias("__n"))
    year = F.substring(F.coalesce(date, F.lit("")), 1, 4)
    label = F.when((F.col("__n") > 1) & (year != ""), F.concat(F.col(source), F.lit(" "), year)).otherwise(F.col(source))
    return df.join(linked, [identity, source], "left").withColumn("label", label).drop("__n")


def pick_run(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """The wanted run if it succeeded, else the newest successful one; at most one row."""
    good = runs.where("status = 'success'")
    wanted = F.lit(False) if run_id is None else F.col("run_id") == run_id
    return good.agg(F.max_by(F.struct(*runs.columns), F.struct(wanted, "calculated_at", "run_id")).alias("r")).where("r IS NOT NULL").select("r.*")

"""The event pipeline as Structured Streaming."""

from __future__ import annotations

import datetime as dt
import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medialake.functions.text import anon_hash
from medialake.functions.times import ZONE
from medialake.operators.filters import admit, validate_events
from medialake.sources.days import DayTable
from medialake.sources.tables import retain, touch

BATCH_EVENTS = 50
EVENTS = (
    "event_id string, occurred_at timestamp, event_type string, visitor_id_hash string, session_id_hash string, page_path string, content_type string, content_id string, resource_id string,"
    " position_seconds double, duration_seconds double, listened_seconds double, playback_rate double, referrer_domain string"
)
VISITORS = "visitor_id_hash string, first_seen_at timestamp, last_seen_at timestamp"


def parse_events(batches: DataFrame) -> DataFrame:
    """Batches as admitted, cleaned and hashed events; at most fifty of a batch. Arrival is the event's time."""
    rows = admit(batches).select("visitor_id", "session_id", F.inline(F.slice("events", 1, BATCH_EVENTS)))
    clean = validate_events(rows)
    return clean.select(
        F.when(F.col("event_id") == "", F.expr("uuid()")).otherwise(F.col("event_id")).alias("event_id"),
        F.current_timestamp().alias("occurred_at"),
        "event_type",
        anon_hash("visitor_id").alias("visitor_id_hash"),
        anon_hash("session_id").alias("session_id_hash"),
        *[c.strip().split()[0] for c in EVENTS.split(",")[5:]],
    )


def dedupe_events(events: DataFrame, horizon: str = "180 days") -> DataFrame:
    """Each event id once within the horizon, which bounds the state."""
    return events.withWatermark("occurred_at", horizon).dropDuplicatesWithinWatermark(["event_id"])


def live_daily(events: DataFrame, tz: str = ZONE, horizon: str = "2 days") -> DataFrame:
    """Running counts of views, plays and downloads by local day, for update mode."""
    return (
        events.withWatermark("occurred_at", horizon)
        .groupBy(F.window(F.from_utc_timestamp("occurred_at", tz), "1 day").alias("w"))
        .agg(F.count_if(F.col("event_type") == "page_view").alias("views"), F.count_if(F.col("event_type") == "audio_play").alias("plays"), F.count_if(F.col("event_type") == "download").alias("downloads"))
        .select(F.to_date("w.start").alias("day"), "views", "plays", "downloads")
    )


def known_visitors(visitors: DayTable, since: dt.datetime | None = None) -> DataFrame:
    """First and last sight of each visitor; every stored sighting carries the first one before it."""
    return visitors.read(since).groupBy("visitor_id_hash").agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))


def store_batch(events: DayTable, visitors: DayTable, days: int, writer: str, now: dt.datetime | None = None):
    """A ``foreachBatch`` sink: new events, sightings of visitors, and days that are too old removed.

    A batch only adds partitions. Which of its ids are stored already is asked of
    the days' filters first; ids are read of those days only that may have some.
    Repeating a batch replaces its partitions, so nothing is there twice; events
    that another batch or writer stored are not added again.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        at = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
        since, name = at - dt.timedelta(days=days), f"{writer}-{epoch}"
        batch = batch.persist()
        try:
            again = events.stored_before(batch, since, but=name)
            events.put(retain(batch.dropDuplicates(["event_id"]).join(again, "event_id", "left_anti"), "occurred_at", days, at), name)
            seen = batch.select("visitor_id_hash", F.col("occurred_at").alias("at"))
            known = visitors.read(since, but=name).join(seen, "visitor_id_hash", "left_semi")
            visitors.put(retain(touch(known, seen, "visitor_id_hash"), "last_seen_at", days, at), name)
        finally:
            batch.unpersist()
        events.expire(days, at)
        visitors.expire(days, at)

    return write


def event_tables(spark: SparkSession, root: str) -> tuple[DayTable, DayTable]:
    """The stored events and visitors below a folder."""
    return DayTable(spark, f"{root}/events", EVENTS, "occurred_at", ident="event_id"), DayTable(spark, f"{root}/visitors", VISITORS, "last_seen_at")


def ingest_events(batches: DataFrame, events: DayTable, visitors: DayTable, checkpoint: str, days: int = 180, now: dt.datetime | None = None):
    """Run what has landed through parsing, deduplication and storage; returns the finished query.

    The checkpoint's folder names the writer, so that two streams into the same
    tables keep their batches apart.
    """
    writer = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    query = dedupe_events(parse_events(batches), f"{days} days").writeStream.foreachBatch(store_batch(events, visitors, days, writer, now)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query

"""When visitors were first and last seen, as state of a stream that forgets them after the retention."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from medialake.sources.buckets import BucketTable

VISITORS = "visitor_id_hash string, first_seen_at timestamp, last_seen_at timestamp"
CHANGES = f"{VISITORS}, expired boolean"
#: Changes as the state gives them, times in microseconds.
_RAW = "visitor_id_hash string, first long, last long, expired boolean"
#: Where the state lives: on disk beside the executors, with its changes in the checkpoint.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Buckets of the stored table.
BUCKETS = 64


def last_visit(times: np.ndarray, known: tuple[int, int] | None, horizon: int) -> tuple[int, int]:
    """First and last of the sightings behind the last gap above ``horizon``; all in microseconds.

    ``known`` is what was known before. A visitor who stays away longer than the
    horizon is forgotten, and comes back as a new one.
    """
    seen = np.sort(times)
    if known is not None:
        if seen[0] < known[0]:
            seen = np.sort(np.concatenate([seen, known]))
        else:
            seen = np.concatenate([[known[1]], np.maximum(seen, known[1])])
    gaps = np.flatnonzero(np.diff(seen) > horizon)
    if len(gaps):
        return int(seen[gaps[-1] + 1]), int(seen[-1])
    first = int(seen[0]) if known is None else min(known[0], int(seen[0]))
    return first, int(seen[-1])


class Visitor(StatefulProcessor):
    """One visitor's first and last sight; a timer at the end of the retention forgets them."""

    def __init__(self, days: float) -> None:
        self.horizon = int(days * 86_400_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "first long, last long")

    def _end(self, last: int) -> int:
        """The first millisecond at which a visitor last seen then is forgotten."""
        return (last + self.horizon) // 1000 + 1

    def _row(self, key, first: int, last: int, expired: bool) -> Row:
        return Row(visitor_id_hash=key[0], first=first, last=last, expired=expired)

    def handleInputRows(self, key, rows, timerValues):
        times = np.fromiter((r.at for r in rows), dtype=np.int64)  # eight bytes a sighting
        known = self.seen.get()
        known = known and (int(known[0]), int(known[1]))
        first, last = last_visit(times, known, self.horizon)
        if (first, last) != known:
            self.seen.update((first, last))
        if known and known[1] != last:
            self.handle.deleteTimer(self._end(known[1]))
        if not known or known[1] != last:
            self.handle.registerTimer(self._end(last))
        yield self._row(key, first, last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        known = self.seen.get()
        self.seen.clear()
        yield self._row(key, int(known[0]), int(known[1]), True)

    def close(self) -> None:
        pass


def visitor_changes(events: DataFrame, days: float, delay: str = "1 hour") -> DataFrame:
    """A stream of what changed: visitors with their new times, and those whose time is up.

    ``events`` has ``visitor_id_hash`` and ``occurred_at``, up to ``delay`` late.
    """
    seen = events.select("visitor_id_hash", "occurred_at", F.unix_micros("occurred_at").alias("at")).withWatermark("occurred_at", delay)
    # rows, not pandas: a frame in and a frame out for each visitor cost more than all the rest
    changes = seen.groupBy("visitor_id_hash").transformWithState(statefulProcessor=Visitor(days), outputStructType=_RAW, outputMode="Update", timeMode="EventTime")
    return changes.select("visitor_id_hash", F.timestamp_micros("first").alias("first_seen_at"), F.timestamp_micros("last").alias("last_seen_at"), "expired")


def visitor_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> BucketTable:
    """One row a visitor; a change rewrites the buckets of its visitors only."""
    return BucketTable(spark, path, VISITORS, ["visitor_id_hash"], buckets)


def keep_visitors(visitors: BucketTable):
    """A ``foreachBatch`` sink. A batch carried out again changes nothing, as its rows say what is, not what is added."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        try:
            # of several rows the newest counts; a visitor forgotten and seen again in one batch is known
            last = batch.groupBy("visitor_id_hash").agg(F.max_by(F.struct("first_seen_at", "last_seen_at", "expired"), F.struct("last_seen_at", ~F.col("expired"))).alias("v")).select("visitor_id_hash", "v.*")
            visitors.upsert(last.where("NOT expired").drop("expired"))
            visitors.remove(last.where("expired"))
        finally:
            batch.unpersist()

    return write


def track_visitors(events: DataFrame, visitors: BucketTable, checkpoint: str, days: float = 180, delay: str = "1 hour"):
    """Runs the stream ``events`` through the state into ``visitors``; returns the finished query."""
    spark = events.sparkSession
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, PROVIDER)
    try:
        query = visitor_changes(events, days, delay).writeStream.outputMode("update").foreachBatch(keep_visitors(visitors)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    return query


def known_since(visitors: BucketTable, since: dt.datetime) -> DataFrame:
    """Visitors last seen at ``since`` or later; files of older ones are not opened."""
    return visitors.scan(("last_seen_at", ">=", since))

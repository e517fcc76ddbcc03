"""First and last sight of visitors: against plain islands, replay, expiry."""

import collections
import datetime as dt
import random

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from medialake.sources.scratch import fresh_path
from medialake.streaming import visitors as v

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def islands(times, horizon):
    first = last = None
    for at in sorted(times):
        first = at if last is None or at - last > horizon else first
        last = at
    return first, last


def test_last_visit_is_the_same_in_any_cut():
    rng = random.Random(1)
    for _ in range(300):
        times = sorted(rng.randrange(0, 1000) for _ in range(rng.randrange(1, 12)))
        want, known, at = islands(times, 90), None, 0
        while at < len(times):
            step = rng.randrange(1, 5)
            part = times[at : at + step]
            rng.shuffle(part)
            known = v.last_visit(np.array(part), known, 90)
            at += step
        assert known == want


def land(spark, path, rows):
    spark.createDataFrame(rows, "visitor_id_hash string, occurred_at timestamp").coalesce(1).write.mode("append").parquet(path)


def stream(spark, path):
    return spark.readStream.schema("visitor_id_hash string, occurred_at timestamp").option("maxFilesPerTrigger", 1).parquet(path)


def state(visitors):
    return {r.visitor_id_hash: (r.first_seen_at, r.last_seen_at) for r in visitors.read().collect()}


def test_state_expires_and_replays(spark):
    path, root = fresh_path(spark, "sightings"), fresh_path(spark, "visitors")
    table = v.visitor_table(spark, f"{root}/table", buckets=4)
    land(spark, path, [("a", START), ("b", START), ("a", START + DAY), ("a", START + DAY / 2)])
    v.track_visitors(stream(spark, path), table, f"{root}/check", days=3)
    assert state(table) == {"a": (START, START + DAY), "b": (START, START)}

    land(spark, path, [("c", START + 3.5 * DAY)])  # the time of b is up, that of a not yet
    v.track_visitors(stream(spark, path), table, f"{root}/check", days=3)
    assert state(table) == {"a": (START, START + DAY), "c": (START + 3.5 * DAY, START + 3.5 * DAY)}

    land(spark, path, [("b", START + 3.6 * DAY), ("a", START + 3.7 * DAY)])  # b comes as a new visitor, a is known
    v.track_visitors(stream(spark, path), table, f"{root}/check", days=3)
    now = state(table)
    assert now["b"] == (START + 3.6 * DAY, START + 3.6 * DAY) and now["a"] == (START, START + 3.7 * DAY)
    at = table.version()
    v.track_visitors(stream(spark, path), table, f"{root}/check", days=3)  # nothing new has landed
    assert state(table) == now

    changes = spark.createDataFrame([("a", START, START + 3.7 * DAY, False), ("z", START, START, True)], v.CHANGES)
    for _ in range(2):  # a batch carried out twice
        v.keep_visitors(table)(changes, 9)
    assert state(table) == now and table.version() > at
    assert {r.visitor_id_hash for r in v.known_since(table, START + 3.65 * DAY).collect()} == {"a"}


def test_many_visitors_in_several_batches(spark):
    rng = random.Random(2)
    path, root = fresh_path(spark, "sightings"), fresh_path(spark, "visitors")
    table, times = v.visitor_table(spark, f"{root}/table", buckets=4), collections.defaultdict(list)
    for day in range(4):
        rows = [(f"u{rng.choice([0, 0, rng.randrange(30)])}", START + DAY * (3 * day + rng.random())) for _ in range(60)]
        land(spark, path, rows)
        for who, at in rows:
            times[who].append(at)
        v.track_visitors(stream(spark, path), table, f"{root}/check", days=4)
    end = max(max(t) for t in times.values()) - 4 * DAY
    want = {who: islands(t, 4 * DAY) for who, t in times.items() if max(t) >= end}
    assert {k: x for k, x in state(table).items() if x[1] >= end} == want


def test_no_frame_for_each_visitor(spark):
    """The state takes and gives rows, with times as numbers; a sighting that changes nothing writes nothing."""
    done = []

    class Seen:
        get = staticmethod(lambda: (5, 9))
        update = staticmethod(lambda value: done.append(("update", value)))

    class Timers:
        registerTimer = staticmethod(lambda at: done.append(("register", at)))
        deleteTimer = staticmethod(lambda at: done.append(("delete", at)))

    visitor = v.Visitor(1)
    visitor.seen, visitor.handle = Seen, Timers
    (row,) = visitor.handleInputRows(("a",), iter([Row(at=7), Row(at=9)]), None)
    assert row.asDict() == {"visitor_id_hash": "a", "first": 5, "last": 9, "expired": False} and done == []
    (row,) = visitor.handleInputRows(("a",), iter([Row(at=11)]), None)
    assert (row.first, row.last) == (5, 11) and [d[0] for d in done] == ["update", "delete", "register"]
